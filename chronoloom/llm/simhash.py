"""Near-duplicate groups by SimHash, linked through BK-trees."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekernel as bk
from .components import connected_components
from .storage import ARROW_ROWS, arrow_rows, broadcast_if_small, columns_of, is_empty, scratch, written

SEED = 42
BLOCK_BITS, BLOCKS = 16, 4
#: A shard of more fingerprints than this is linked by radius-one balls instead of a tree.
TREE_LIMIT = 1024


def fingerprint_buffers(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """SimHash of each document: XXH64 (seed 42) of its space-joined shingles of ``size`` words.

    A document of fewer words has its whole sequence as one shingle; one without words gets zero.
    """
    words = bk.words_of(data, offsets)
    count = np.diff(words.first)
    keep = ~words.space
    if len(data):
        follows = np.empty(len(data), dtype=bool)
        follows[0] = False
        follows[1:] = keep[:-1]
        follows[offsets[:-1][offsets[:-1] < len(data)]] = False
        keep = keep | follows
    place = np.cumsum(keep)
    clean = np.where(words.space, np.uint8(0x20), words.lower)[keep]
    starts, ends = place[words.starts] - 1, place[words.ends - 1]
    n_shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(n_shingles)])
    # index of each shingle's first word, and of its last
    head = np.arange(first[-1]) - np.repeat(first[:-1] - words.first[:-1], n_shingles)
    last = head + np.repeat(np.minimum(count, size) - 1, n_shingles)
    hashes = np.empty(first[-1], dtype=np.uint64)
    for a in range(0, len(head), 1 << 18):
        s, e = starts[head[a : a + (1 << 18)]], ends[last[a : a + (1 << 18)]]
        base, top = (int(s[0]), int(e.max())) if len(s) else (0, 0)
        hashes[a : a + (1 << 18)] = bk.xxh64(clean[base:top], s - base, e - s, SEED)
    return bk.simhash_bits(bk.bit_counts(hashes, first), n_shingles)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp)`` for every row, fp a signed 64-bit integer. Null text counts as empty."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bk.text_buffers(batch.column(1))
            parts = [fingerprint_buffers(data[off[a] : off[b]], off[a : b + 1] - off[a], size) for a, b in bk.doc_chunks(off)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])
        bk.release_memory()

    return source.mapInArrow(run, schema)


class BKTree:
    """Integers under Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Values at most ``radius`` away. Only edges whose key is within the radius of the
        distance to the parent are followed (triangle inequality)."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[at])
            child = self.children[at]
            if child:
                stack += [c for k in range(d - radius, d + radius + 1) if (c := child.get(k)) is not None]
        return found

    def nearest(self, value: int, count: int, fits: Callable[[int], bool]) -> list[int]:
        """Places, in the order of adding, of the ``count`` nearest values whose place fits, nearest first; all, if fewer."""
        best: list[tuple[int, int]] = []
        worst, stack = 65, [(0, 0)] if self.values else []
        while stack:
            least, at = stack.pop()
            if least >= worst:
                continue
            d = (self.values[at] ^ value).bit_count()
            if d < worst and fits(at):
                insort(best, (d, at))
                if len(best) >= count:
                    del best[count:]
                    worst = best[-1][0]
            child = self.children[at]
            if child:
                stack += sorted(((abs(k - d), c) for k, c in child.items()), reverse=True)
        return [at for _, at in best]


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning set of links between the values within ``radius`` of each other."""
    tree, parent, links = BKTree(), {}, []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for v in values:
        parent[v] = v
        for w in tree.within(v & 0xFFFFFFFFFFFFFFFF, radius):
            w = w if w < 1 << 63 else w - (1 << 64)
            a, b = root(v), root(w)
            if a != b:
                parent[a] = b
                links.append((v, w))
        tree.add(v & 0xFFFFFFFFFFFFFFFF)
    return links


def _tree_edges(groups: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [x for values in batch.column(0).to_pylist() for x in tree_links(values, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["u", "v"])

    return groups.select("fps").mapInArrow(run, "u long, v long")


def links(distinct_fps: DataFrame, radius: int = 2, tree_limit: int = TREE_LIMIT) -> DataFrame:
    """Edges ``(u, v)`` that connect all fingerprints of ``distinct_fps(fp)`` within ``radius`` (0 to 2).

    Two fingerprints that differ in at most two bits agree on two of four 16-bit blocks, so they
    meet in one of six shards keyed by a pair of blocks. Each shard has its own BK-tree, built where
    the shard's fingerprints are: a broadcast tree over all fingerprints would grow with the corpus.
    A shard of over ``tree_limit`` fingerprints (clusters of near copies share blocks) is exact by
    another way: both ends of a link lie in the radius-one ball of a fingerprint between them, and
    no ball holds more than 65.
    """
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError("two shared blocks of four are certain only up to two differing bits")
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    block = [F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND((1 << BLOCK_BITS) - 1) for i in range(BLOCKS)]
    keys = F.array(*[F.lit(n << 2 * BLOCK_BITS) + block[i] * (1 << BLOCK_BITS) + block[j] for n, (i, j) in enumerate(pairs)])
    shards = distinct_fps.select("fp", F.explode(keys).alias("shard"))
    hot = written(shards.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > tree_limit).select("shard"), "hot")
    grouped = shards.join(hot, "shard", "left_anti").groupBy("shard").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    by_tree = _tree_edges(grouped, radius)
    crowded = shards.join(hot, "shard", "left_semi").select("fp").distinct()
    if radius == 2:
        centres = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) if b < 63 else -(1 << 63)).cast("long")) for b in range(64)])
        balls = crowded.select("fp", F.explode(centres).alias("centre")).groupBy("centre").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        by_ball = balls.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").select("u", "v").distinct()
    elif radius == 1:
        flips = F.array(*[F.col("fp").bitwiseXOR(F.lit((1 << b) if b < 63 else -(1 << 63)).cast("long")) for b in range(64)])
        by_ball = crowded.select(F.col("fp").alias("v"), F.explode(flips).alias("u")).join(crowded.select(F.col("fp").alias("u")), "u").select("u", "v")
    else:
        return by_tree
    return by_tree.unionByName(by_ball)


def near_duplicate_groups(docs: DataFrame, radius: int = 2, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component)`` per row: rows linked directly or through others share a component.

    component is the smallest id of the group. Null text is an empty text; empty texts have
    fingerprint zero and are linked like any other. Repeated rows come out as often as they came
    in. A null id is never a component unless its whole group has none.
    """
    with scratch(docs.sparkSession), arrow_rows(docs.sparkSession, ARROW_ROWS):
        rows = written(fingerprints(docs, id_col, text_col, size), "fingerprints", keep=True)
        distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fps")
        return name_groups(rows, distinct, links(distinct.select("fp"), radius))


def name_groups(rows: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, fp, component)`` of ``rows(id, fp)``, from ``distinct(fp, least)`` and edges ``(u, v)`` between fingerprints.

    Of the tables written here and before only the names' and the rows' are still needed afterwards.
    """
    roots = written(connected_components(edges), "roots")
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = written(linked.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "component")
    names = written(distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")), "names", keep=True)
    return rows.join(names, "fp").select("id", "fp", "component")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups_of: Callable[..., DataFrame] = near_duplicate_groups, **options) -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group, that of the smallest id.

    ``groups_of`` is given the options and says what a group is. Null ids count as larger than any; of rows equal in every column one stays.
    """
    columns = columns_of(docs)
    last = F.lit((1 << 63) - 1)
    # the rows themselves are one struct, so their columns may have any names
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.xxhash64(*columns).alias("row"), F.col(text_col).alias("text"), F.struct(*columns).alias("doc"))
    with scratch(docs.sparkSession):
        groups = groups_of(keyed.select(F.struct("id", "row").alias("name"), "text"), id_col="name", text_col="text", **options)
        kept = written(groups.where("id = component").groupBy("id.id", "id.row").agg(F.count("*").alias("n")), "kept", keep=True)
    out = keyed.select("id", "row", "doc").join(broadcast_if_small(kept.select("id", "row"), 32), ["id", "row"], "left_semi")
    if not is_empty(kept.where("n > 1")):
        out = out.dropDuplicates(["id", "row"])
    return out.select("doc.*")
