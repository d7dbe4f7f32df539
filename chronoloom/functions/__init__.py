"""Row-wise column functions: pitch, time and text arithmetic."""
