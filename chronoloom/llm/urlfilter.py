"""URL rules by host suffix and path prefix, looked up in Bloom filter cascades.

DataFrame expressions only: a cascade is a handful of literal bit arrays, and a lookup is a chain
of bit tests, so judging a table of urls needs no join and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import is_empty, scratch, written


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` has its bits, 64 to a word, as one text of whole numbers.

    Spark folds the text into one literal array when it plans a query, so a filter of any size is a
    single expression: about 1.5 bits for each hash of each key.
    """

    seed: int
    hashes: int
    size: int
    words: str

    def holds(self, key: Column) -> Column:
        bits = F.split(F.lit(self.words), ",").cast("array<bigint>")
        spots = F.array(*_positions(key, self.seed, self.hashes, 64 * self.size))
        return F.forall(spots, lambda p: F.getbit(F.element_at(bits, (F.shiftright(p, 6) + 1).cast("int")), p.bitwiseAND(63).cast("int")) == 1)


def _positions(key: Column, seed: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + j)), F.lit(bits).cast("long")) for j in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of ``keys(key)`` with false-positive rate about ``rate``."""
    hashes = max(1, round(-math.log2(rate)))
    size = max(1, math.ceil(n * hashes / math.log(2) / 64))
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, hashes, 64 * size))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    found = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # at most `size` rows
    words = np.zeros(size, dtype=np.int64)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return Level(seed, hashes, size, ",".join(map(str, words.tolist())))


@dataclass(frozen=True)
class Cascade:
    """Exact membership over the universe it was built for."""

    levels: tuple[Level, ...] = field(default=())

    def member(self, key: Column) -> Column:
        """True if ``key`` (of the universe) is listed: the first level that lacks it decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[n - 1].holds(key), F.lit(n % 2 == 0)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade that tells the keys of ``listed(key)`` from all other keys of ``universe(key)``.

    Level 1 holds the listed keys; level 2 its false positives among the whole universe; level 3 the
    listed keys that level 2 holds by mistake, and so on until a level makes none. Level 1's rate
    is tuned so that level 2 is about as large as the list, whatever the universe's size, so the
    cascade grows with the list alone. Null keys are ignored; an empty list gives a cascade without
    levels, which holds nothing.
    """
    with scratch(universe.sparkSession):
        listed = written(listed.where("key is not null").select("key").distinct(), "listed")
        n = listed.count()
        if not n:
            return Cascade()
        universe = universe.where("key is not null").select("key")
        size = universe.agg(F.approx_count_distinct("key")).first()[0]
        levels = [_level(listed, n, min(0.5, n / max(size, 1)), 1)]
        wrong = written(universe.where(levels[0].holds(F.col("key"))).distinct().join(listed, "key", "left_anti"), "cascade")
        older, newer = listed, wrong  # the set that the last level encodes, and what it holds by mistake
        while not is_empty(newer):
            levels.append(_level(newer, newer.count(), 0.5, len(levels) + 1))
            older, newer = newer, written(older.where(levels[-1].holds(F.col("key"))), "cascade")
    return Cascade(tuple(levels))


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row.

    ``rules`` are (``allow`` or ``block``, host followed by the start of a path). A rule fits its
    host and all subdomains where the url's path starts with the rule's; the longest wins, block
    before allow where both list the same rule. A url that no rule fits is on no list: verdict
    ``default``, rule null. Every pair of a list and a (host suffix, path prefix) that is as long as
    some rule's is a key of the universe, so lookups are exact. Suffixes of more labels than any
    rule's host has fit none and are not made, however long the host. Repeated rows come out as
    often; other columns may have any names.
    """
    rules = sorted(set(rules))
    spark = pages.sparkSession
    lengths = sorted({len(rule) - rule.index("/") for _, rule in rules})
    most = max((rule[: rule.index("/")].count(".") + 1 for _, rule in rules), default=0)
    judged = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    last = F.slice(labels, F.greatest(F.size(labels) - most + 1, F.lit(1)), F.lit(max(most, 1)))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    # one cascade holds both lists: a key begins with its list's letter
    universe = judged.select(F.explode(keys).alias("key")).select(F.explode(F.array(F.concat(F.lit("b"), "key"), F.concat(F.lit("a"), "key"))).alias("key"))
    listed = spark.createDataFrame([(("b" if what == "block" else "a") + rule,) for what, rule in rules], "key string")
    cascade = build_cascade(listed, universe)

    def verdict(key: Column) -> Column:
        return F.when(cascade.member(F.concat(F.lit("b"), key)), "block").when(cascade.member(F.concat(F.lit("a"), key)), "allow")

    found = F.filter(F.transform(F.col("keys"), lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), verdict(k).alias("verdict"))), lambda f: f["verdict"].isNotNull())
    out = judged.withColumn("keys", keys).withColumn("best", F.try_element_at(F.sort_array(found, asc=False), F.lit(1)))
    return out.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
