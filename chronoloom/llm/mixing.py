"""Mixing sources to target weights: DataFrame expressions only.

Words are packed into fixed-length blocks per source; every output shard draws how many of its slots
each source gets; a source's slots are mapped through pseudorandom permutations of its block
numbers, and blocks are joined by number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .storage import broadcast_if_light, columns_of, numbered, running_total, scratch, written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SLOTS_PER_SHARD, DOCS_PER_CHUNK = 4096, 512
WEIGHTS = (1, 2, 3)
CAP = 3
#: By how much of its target, at most, the draw may miss a source's number of slots.
TOLERANCE = 0.01
#: Rounds of the permutations, and how often an index is mapped again at most (see ``_permuted``).
ROUNDS, WALK = 6, 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and tells a null source from every name."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


@dataclass(frozen=True)
class Mix:
    """``docs``: (row, skey, size, chunk, n, start) with start counted in words of the source;
    ``sources``: (skey, source_size, target, blocks, ...); ``drawn``: (skey, block, times)."""

    docs: DataFrame
    sources: DataFrame
    drawn: DataFrame
    block: int


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``n``, ``weight`` and ``target`` to ``sources(skey, source, source_size)``.

    Weights 1, 2, 3 repeat over the sources in code-point order, null last; they share the total of
    all sizes. A target stops at three times its source's size and the excess is shared again by
    weight, until no further target stops. Sums are of whole numbers, so reruns agree to the last bit.
    """
    s = numbered(sources, F.col("source").asc_nulls_last())
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("n") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    s = written(s.withColumn("cap", F.col("source_size") * CAP), "mix-weights")
    level, stopped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        r = s.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("weights"), F.count(F.when(full, 1)).alias("stopped")
        ).first()
        if r["stopped"] == stopped or not r["weights"]:
            break
        level, stopped = ((r["all"] or 0) - (r["caps"] or 0)) / r["weights"], r["stopped"]
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))).drop("cap")


def _hash(*cols: Column) -> Column:
    """A whole number from 0 on."""
    return F.xxhash64(*cols).bitwiseAND((1 << 63) - 1)


def _permuted(k: Column, n: Column, *seeds: Column) -> Column:
    """The place of ``k`` in a pseudorandom permutation of the numbers below ``n``.

    A Feistel network over pairs (left, right) below a and b, with a * b the least such product of
    nearly equal numbers that holds n; a result beyond n - 1 is mapped again until it is below. At
    most a - 1 numbers lie beyond, so that many steps always do; and where a is over WALK, that many
    fail with a chance under WALK ** -WALK, in which case an error is raised.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def network(x: Column) -> Column:
        pair = F.struct((x / b).cast("long").alias("l"), (x % b).alias("r"))

        def half(p: Column, i: Column) -> Column:
            left, right = p["l"], p["r"]
            return F.when(i % 2 == 0, F.struct(((left + _hash(i, right, *seeds) % a) % a).alias("l"), right.alias("r"))).otherwise(F.struct(left.alias("l"), ((right + _hash(i, left, *seeds) % b) % b).alias("r")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, half, lambda p: p["l"] * b + p["r"])

    steps = F.sequence(F.lit(1).cast("long"), F.least(a, F.lit(WALK).cast("long")))
    end = F.aggregate(steps, network(k), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("a permutation did not settle")).cast("long"))


def draw_slots(sources: DataFrame, seed: int) -> DataFrame:
    """``(shard, skey, block)``: the output shards' slots, and which block of which source each gets.

    A source is due target * blocks / size slots. There are as many slots as are due in all, in
    shards of SLOTS_PER_SHARD; each draws its source with the sources' shares, so a shard's counts are
    multinomial. Counts are then corrected to be within TOLERANCE of what is due: of too many slots
    the last are left out, and missing ones fill a shard after all others. Slots of a source are
    numbered over the shards, and number k takes block p(k modulo blocks), p a permutation of the
    source's blocks with a key of its own in each pass. No block is taken more than CAP times.
    """
    s = sources.where("source_size > 0").select("skey", "n", "blocks", F.greatest(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.lit(1.0)).cast("long").alias("due"))
    s = written(running_total(s, [], "n", "due", "from"), "mix-due")
    due, n_sources = s.agg(F.sum("due"), F.count("*")).first()
    spark = sources.sparkSession
    if not due:
        return spark.createDataFrame([], "shard long, skey string, block long")
    # sources lie side by side on a line; a cell of the line has few of them
    width = max(1, due // (2 * n_sources))
    ends = F.expr(f"from div {width}"), F.expr(f"(from + due - 1) div {width}")
    cells = s.select("skey", "from", "due", F.explode(F.sequence(*ends)).alias("cell"))
    cells = broadcast_if_light(cells, F.octet_length("skey") + 64)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    line = spark.range(0, due, 1, parts).select(F.expr(f"id div {SLOTS_PER_SHARD}").alias("shard"), (_hash(F.lit(seed), F.col("id")) % due).alias("at"))
    line = line.withColumn("cell", F.expr(f"at div {width}"))
    drawn = line.join(cells, "cell").where((F.col("at") >= F.col("from")) & (F.col("at") < F.col("from") + F.col("due"))).groupBy("skey", "shard").agg(F.count("*").alias("count"))
    drawn = written(drawn, "mix-counts")
    totals = s.join(drawn.groupBy("skey").agg(F.sum("count").alias("got")), "skey", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    least, most = F.ceil(F.col("due") * (1 - TOLERANCE)), F.least(F.floor(F.col("due") * (1 + TOLERANCE)), F.col("blocks") * CAP)
    totals = totals.select("skey", "blocks", "got", F.greatest(F.least(F.col("got"), most), least).cast("long").alias("take"))
    totals = written(totals, "mix-totals")
    last = -(-due // SLOTS_PER_SHARD)
    missing = totals.where("take > got").select("skey", F.lit(last).cast("long").alias("shard"), (F.col("take") - F.col("got")).alias("count"))
    counts = running_total(drawn.unionByName(missing), ["skey"], "shard", "count", "base")
    known = broadcast_if_light(totals.select("skey", "blocks", "take"), F.octet_length("skey") + 64)
    # a row here stands for a shard's slots of a source: spread them before they are unfolded
    counts = counts.join(known, "skey").repartition(parts, "skey", "shard")
    slots = counts.select("skey", "shard", "blocks", "take", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("count") - 1)).alias("k")).where("k < take")
    at = _permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(seed + 1), F.col("skey"), F.expr("k div blocks"))
    return slots.select("shard", "skey", at.alias("block"))


def plan_mix(rows: DataFrame, block: int = BLOCK_WORDS, seed: int = 11) -> Mix:
    """Plan the mix of ``rows(row, source, size)``; row identifies a document, repeats allowed.

    Documents are dealt by a hash into chunks of their source, of about 500 documents whatever the
    source's share, numbered within the chunk and offset by the chunks before; so no task sees a
    whole source, and the order doesn't depend on partitions.
    """
    with scratch(rows.sparkSession):
        rows = written(rows.select("row", "source", "size", source_key(F.col("source")).alias("skey")), "mix-rows", keep=True)
        chunks = max(1, math.ceil(rows.count() / DOCS_PER_CHUNK))
        rows = rows.withColumn("chunk", _hash(F.lit(seed), F.col("row"), F.col("size")) % chunks)
        sums = written(rows.groupBy("skey", "source", "chunk").agg(F.sum("size").alias("words")), "mix-chunks")
        by_source = sums.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
        sources = written(targets(by_source).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")), "mix-sources", keep=True)
        offsets = written(running_total(sums.select("skey", "chunk", "words"), ["skey"], "chunk", "words", "base").drop("words"), "mix-offsets", keep=True)
        in_chunk = W.partitionBy("skey", "chunk").orderBy("row", "size")
        rows = rows.select(
            "row", "skey", "size", "chunk", F.row_number().over(in_chunk).alias("n"),
            F.coalesce(F.sum("size").over(in_chunk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("local"),
        )
        docs = rows.join(offsets, ["skey", "chunk"]).select("row", "skey", "size", "chunk", "n", (F.col("base") + F.col("local")).alias("start"))
        # written, so that its size is known: an estimate from the few rows of sources would broadcast it
        drawn = draw_slots(sources, seed).groupBy("skey", "block").agg(F.count("*").alias("times"))
        return Mix(docs, sources, written(drawn, "mix-drawn", keep=True), block)


def pieces(mix: Mix) -> DataFrame:
    """``(row, skey, size, chunk, n, at, words, times)``: the parts of each document by block.

    at counts words from the document's beginning; a document without words has one row of nulls.
    """
    last = F.expr(f"(start + size - 1) div {mix.block}")
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {mix.block}"), last))
    parts = mix.docs.select("*", F.explode_outer(blocks).alias("block"))
    begin, stop = F.greatest(F.col("block") * mix.block, F.col("start")), F.least((F.col("block") + 1) * mix.block, F.col("start") + F.col("size"))
    parts = parts.select("row", "skey", "size", "chunk", "n", "block", (begin - F.col("start")).alias("at"), (stop - begin).alias("words"))
    return parts.join(mix.drawn, ["skey", "block"], "left").select("row", "skey", "size", "chunk", "n", "at", "words", F.coalesce("times", F.lit(0).cast("long")).alias("times"))


def _with_sources(df: DataFrame, sources: DataFrame) -> DataFrame:
    return df.join(broadcast_if_light(sources.select("skey", "source_size", "target"), F.octet_length("skey") + 64), "skey")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """``(id, size, source_size, target, taken)`` for every row of ``docs``.

    Null text has size 0 and is never taken; null sources are a source of their own; rows that
    repeat an id are documents of their own, told apart by their place in the chunk.
    """
    mix = plan_mix(docs.select(F.col(id_col).alias("row"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), block, seed)
    taken = pieces(mix).groupBy("row", "skey", "size", "chunk", "n").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    return _with_sources(taken, mix.sources).select(F.col("row").alias("id"), "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", block: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: each document's taken words, joined by spaces.

    Pass by pass, a document keeps the words of its blocks that the mix takes once, then those that
    it takes twice, then thrice; documents of which nothing is taken are left out. ``length_col``
    is set to the new length. Rows that are equal in every column are documents of their own.
    """
    columns = columns_of(docs)
    # the rows themselves are one struct, so their columns may have any names
    keyed = docs.select(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), F.struct(*columns).alias("doc"))
    mix = plan_mix(keyed.select(F.struct("a", "b").alias("row"), "source", word_count(F.col("text")).alias("size")), block, seed)
    # a repeated row has parts for each of its places in the chunk, and its text is joined to each
    parts = pieces(mix).where("times > 0").groupBy("row", "chunk", "n").agg(F.sort_array(F.collect_list(F.struct("at", "words", "times"))).alias("parts"))
    parts = parts.select("row.a", "row.b", "parts")
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))

    def taken(w: Column) -> Column:
        def turn(t: Column) -> Column:
            return F.flatten(F.transform(F.filter("parts", lambda p: p["times"] >= t), lambda p: F.slice(w, (p["at"] + 1).cast("int"), p["words"].cast("int"))))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.array_max("parts.times").cast("int")), turn))

    # bound as a lambda's argument, the words are split once and not for every slice of them
    mixed = F.array_join(F.element_at(F.transform(F.array(words), taken), 1), " ")
    out = keyed.select("a", "b", "text", "doc").dropDuplicates(["a", "b"]).join(parts, ["a", "b"]).select("doc", mixed.alias("text"))
    own = {text_col: F.col("text")}
    if length_col in docs.columns:
        own[length_col] = F.length("text").cast(docs.schema[length_col].dataType)
    return out.select(*[own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
