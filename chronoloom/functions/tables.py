"""Table functions for SQL: the walks over a token's reading."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import text


@udtf(returnType="segment string, reading string, begin int, stop int")
class Furigana:
    """``furigana(surface, reading)``: the runs of a token with the readings of its kanji."""

    def eval(self, surface: str, reading: str) -> Iterator[tuple]:
        yield from text.furigana(surface or "", reading)


@udtf(returnType="place int, mora string")
class Morae:
    """``morae(kana)``: the morae of a text in order."""

    def eval(self, kana: str) -> Iterator[tuple]:
        yield from enumerate(text.morae(kana or ""))


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL under their names in lower case."""
    for f in (Furigana, Morae):
        spark.udtf.register(f.func.__name__.lower() if hasattr(f, "func") else f.__name__.lower(), f)
