"""Table operators. Each takes DataFrames with explicit key and order columns and returns a DataFrame."""
