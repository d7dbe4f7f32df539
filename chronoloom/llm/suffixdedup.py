"""Removal of long repeated byte strings, found by interval expansion on Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekernel as bk
from .storage import ARROW_ROWS, arrow_rows, broadcast_if_small, is_empty, scratch, written

MIN_BYTES = 200
#: Bytes of an anchor; every string of MIN_BYTES owns the anchor of least hash inside it.
ANCHOR = 16
#: Contexts of one anchor beyond which its strings are counted by hash instead of sorted.
GROUP_LIMIT = 1024
#: Neighbouring starts of a crowded anchor that are looked at together.
CELL = 16
#: Bytes of contexts that one transform holds.
SHARD_BYTES = 1 << 18
#: Lists of spans up to this size are broadcast to the texts; larger ones meet them by shuffle. The lists of
#: contexts for the transforms are the longest and always do, so that memory and disk follow the input.
BROADCAST_BYTES = 32 << 20
#: Bytes of texts in index arrays at once.
TEXT_BYTES = 1 << 19
#: Rows that share a key beyond which they are not brought together by it.
HOT_ROWS = 4096
#: Starts handled at once in a long document.
_STRIDE = 1 << 21
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    pad = np.zeros(len(data) + 16, dtype=np.uint8)
    pad[: len(data)] = data
    lane = np.ndarray((len(data) + 9,), dtype="<u8", buffer=pad, strides=(1,))
    n = len(data) - ANCHOR + 1
    h = lane[:n] * _A ^ (lane[8 : n + 8] * _B >> np.uint64(7))
    h = (h ^ (h >> np.uint64(31))) * _C
    return h ^ (h >> np.uint64(29))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by running minima from both ends of blocks of that width."""
    n = len(x)
    rows = -(-n // width)
    p = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    p[:n] = x
    p = p.reshape(rows, width)
    ahead = np.minimum.accumulate(p, axis=1).ravel()
    behind = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """(document, first start, starts, anchor hash, context hash) of every run of owned starts.

    A start is a byte at which a string of ``length`` bytes begins inside its document; it belongs
    to the anchor of least hash in that string, the last of equals. Which anchor that is depends on
    the string alone, so equal strings have equal anchors at equal places. The context is the bytes
    from the run's first start to the end of its last string; its hash is 64 bits of BLAKE2b.
    """
    none = tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    found = []
    low = np.uint64((1 << 22) - 1)
    for base in range(0, len(data) - length + 1, _STRIDE):
        part = data[base : base + _STRIDE + length - 1]
        h = _anchor_hashes(part)
        least = _sliding_min((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), length - ANCHOR + 1)
        place = (low - (least & low)).astype(np.int64)
        starts = np.arange(base, base + len(place))
        doc = np.searchsorted(offsets, starts[:: max(1, len(starts) - 1)] if len(starts) > 1 else starts, side="right") - 1
        cuts = offsets[doc[0] : doc[-1] + 2]
        end = np.repeat(cuts[1:], np.diff(np.clip(cuts, base, base + len(place))))
        valid = starts + length <= end
        change = valid.copy()
        change[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        first = np.flatnonzero(change)
        total = np.concatenate([[0], np.cumsum(valid)])
        count = np.diff(np.append(total[first], total[-1]))
        found.append((starts[first], count, h[place[first]]))
    lo, count, a = (np.concatenate(x) for x in zip(*found, strict=True))
    raw, digest = data.tobytes(), hashlib.blake2b
    c = np.frombuffer(b"".join([digest(raw[s:e], digest_size=8).digest() for s, e in zip(lo.tolist(), (lo + count - 1 + length).tolist(), strict=True)]), dtype=np.uint64)
    return np.searchsorted(offsets, lo, side="right") - 1, lo, count, a, c


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` symbols.

    The first key packs as many symbols as fit 63 bits; each further key packs the ranks at three
    places, which triples what is known.
    """
    n = len(text)
    if n >= 1 << 21:
        raise ValueError("a shard holds fewer than 2**21 symbols")
    used = np.zeros(int(text.max()) + 1, dtype=bool)
    used[text] = True
    dense = (np.cumsum(used) - used[0]).astype(np.uint64)
    bits = max(1, int(dense[-1]).bit_length())
    known = 63 // bits
    pad = np.concatenate([dense[text], np.zeros(known, np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for j in range(known):
        key = (key << np.uint64(bits)) | pad[j : j + n]
    order = np.argsort(key)
    while known < depth:
        s = key[order]
        rank = np.zeros(n + 2 * known, dtype=np.uint64)
        step = np.ones(n, dtype=np.uint64)
        step[1:] = s[1:] != s[:-1]
        rank[order] = np.cumsum(step)
        key = (rank[:n] << np.uint64(42)) | (rank[known : n + known] << np.uint64(21)) | rank[2 * known : n + 2 * known]
        order = np.argsort(key)
        known *= 3
    return order


def long_prefix_boundaries(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, for each whether it shares ``length`` symbols with the one before).

    ``text`` ends in a symbol that is less than all others and occurs nowhere else. The intervals of
    the suffix order that hold the occurrences of a string are extended backward, symbol by symbol,
    through the Burrows-Wheeler transform, breadth first from the empty string. An interval of a
    string of l + 1 symbols whose upper end was not seen before proves a common prefix of l there,
    so prefixes are found by increasing value; only such intervals are extended further, and the
    search stops at ``length``. Ends never seen have longer common prefixes.
    """
    order = suffix_order(text, length + 1)
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, dtype=np.int64)
    lf[by_symbol] = np.arange(n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    following = np.full(n, n, dtype=np.int64)
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    preceding = np.full(n, -1, dtype=np.int64)
    preceding[by_symbol[1:][same]] = by_symbol[:-1][same]
    unseen = np.ones(n + 1, dtype=bool)
    unseen[0] = unseen[n] = False
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        size = hi - lo
        stop = np.cumsum(size)
        at = np.arange(stop[-1]) + np.repeat(lo - stop + size, size)
        ends = np.sort(lf[at[following[at] >= np.repeat(hi, size)]]) + 1
        begins = np.sort(lf[at[preceding[at] < np.repeat(lo, size)]])
        fresh = unseen[ends]
        lo, hi = begins[fresh], ends[fresh]
        unseen[hi] = False
        if not len(hi):
            break
    unseen[n] = False
    return order, unseen[:n]


def repeated_starts(contexts: list[bytes], length: int = MIN_BYTES) -> np.ndarray:
    """Over the contexts laid end to end with one byte between: at which places a string of
    ``length`` bytes starts that also starts at another place (strings across a gap don't count)."""
    parts = []
    for c in contexts:
        parts += [np.frombuffer(c, np.uint8).astype(np.uint16) + np.uint16(2), np.ones(1, np.uint16)]
    text = np.concatenate([*parts, np.zeros(1, np.uint16)])
    order, shared = long_prefix_boundaries(text, length)
    again = shared.copy()
    again[:-1] |= shared[1:]
    out = np.zeros(len(text), dtype=bool)
    out[order[again]] = True
    stop = np.cumsum([len(c) + 1 for c in contexts])
    for e, c in zip(stop.tolist(), contexts, strict=True):
        out[max(e - 1 - (length - 1), e - 1 - len(c)) : e] = False
    return out[:-1]


_KEY = [T.StructField("key", T.LongType())]
_ANCHORS = T.StructType([*_KEY, T.StructField("lo", T.IntegerType()), T.StructField("cnt", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("c", T.LongType())])
_SPANS = T.StructType([*_KEY, T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
_CONTEXTS = T.StructType([T.StructField("a", T.LongType()), *_KEY, T.StructField("lo", T.IntegerType()), T.StructField("cnt", T.IntegerType()), T.StructField("body", T.BinaryType()), T.StructField("left", T.IntegerType())])
_CELLS = T.StructType([
    T.StructField("a", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("hl", T.LongType()), T.StructField("hs", T.LongType()),
    *_KEY, T.StructField("s", T.IntegerType()), T.StructField("fine", T.ArrayType(T.LongType())),
])


def _anchor_table(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bk.text_buffers(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for x, y in bk.doc_chunks(off, TEXT_BYTES):
                doc, lo, cnt, a, c = anchors(data[off[x] : off[y]], off[x : y + 1] - off[x], length)
                row = doc + x
                yield pa.RecordBatch.from_arrays([pa.array(keys[row]), pa.array((lo - (off[row] - off[x])).astype(np.int32)), pa.array(cnt.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], names=_ANCHORS.names)
        bk.release_memory()

    return texts.mapInArrow(run, _ANCHORS)


def _to_texts(texts: DataFrame, by_doc: DataFrame, how: str, may_broadcast: bool) -> DataFrame:
    """Join lists of places to the texts, where allowed without moving the texts if the lists are small."""
    fields = [f.name for f in by_doc.schema["places"].dataType.elementType.fields]
    # an array of structs takes 16 bytes more by element than an array by field
    flat = by_doc.select("key", *[F.col(f"places.{f}").alias(f) for f in fields])
    if may_broadcast:
        size = by_doc.agg(F.sum(F.size("places")), F.count("*")).first()
        if 8 * len(fields) * (size[0] or 0) + 128 * size[1] <= BROADCAST_BYTES:
            flat = F.broadcast(flat)
    else:
        flat = flat.hint("merge")
    return texts.join(flat, "key", how).select(*texts.columns, *fields)


def _places(batch: pa.RecordBatch, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of places by row, the lists' elements column by column); a null list is empty."""
    lists = [batch.column(batch.schema.get_field_index(c)) for c in columns]
    n = np.asarray(pc.fill_null(pc.list_value_length(lists[0]), 0), dtype=np.int64)
    return n, [pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in lists]


def _in_groups(rows: DataFrame, groups: DataFrame, keys: list[str], among: bool = True) -> DataFrame:
    """The rows whose ``keys`` are in ``groups(*keys, n)``, or those whose are not.

    n says how many rows have the keys. Groups of over HOT_ROWS are few (the rows' number over HOT_ROWS
    at most); theirs are looked up where the rows are, so that a group isn't brought to one task.
    """
    hot = written(groups.where(F.col("n") > HOT_ROWS).select(*keys), "hot-groups")
    how = "left_semi" if among else "left_anti"
    if is_empty(hot):
        return rows.join(groups.select(*keys), keys, how)
    hot = broadcast_if_small(hot, 40)
    rest = rows.join(hot, keys, "left_anti").join(groups.where(F.col("n") <= HOT_ROWS).select(*keys), keys, how)
    return rest.unionByName(rows.join(hot, keys, "left_semi")) if among else rest


def _contexts(joined: DataFrame, length: int, pad: int = 0) -> DataFrame:
    """The bytes of each listed context, with up to ``pad`` more on both sides; left: how many before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bk.text_buffers(batch.column(1))
            n, (anchor, los, cnts) = _places(batch, ["a", "lo", "cnt"])
            first = np.concatenate([[0], np.cumsum(n)])
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in bk.doc_chunks(off, TEXT_BYTES):
                mine = slice(first[a], first[b])
                lo, cnt = los[mine], cnts[mine]
                base = np.repeat(off[a:b] - off[a], n[a:b])
                stop = np.repeat(off[a + 1 : b + 1] - off[a], n[a:b])
                left = np.minimum(lo, pad)
                raw = data[off[a] : off[b]].tobytes()
                ends = np.minimum(base + lo + cnt + length - 1 + pad, stop)
                body = [raw[s:e] for s, e in zip((base + lo - left).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[mine]), pa.array(np.repeat(own[a:b], n[a:b])), pa.array(lo), pa.array(cnt), pa.array(body, pa.binary()), pa.array(left.astype(np.int32))], names=_CONTEXTS.names)
        bk.release_memory()

    return joined.mapInArrow(run, _CONTEXTS)


def _spans_by_transform(contexts: DataFrame, length: int) -> DataFrame:
    """Covered spans, from transforms over shards of whole anchor groups."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        again = repeated_starts([r[4] for r in rows], length)
        size = np.array([len(r[4]) + 1 for r in rows])
        base = np.cumsum(size) - size
        edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(base, s, side="right") - 1
        lo = np.array([r[2] for r in rows])[owner] - base[owner]
        keys = np.array([r[1] for r in rows])[owner]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array((s + lo).astype(np.int32)), pa.array((e - 1 + length + lo).astype(np.int32))], names=_SPANS.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)
        bk.release_memory()

    return contexts.mapInArrow(run, _SPANS)


def cells_of(data: np.ndarray, off: np.ndarray, left: np.ndarray, cnt: np.ndarray, a: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(context, cell, first start, starts, long hash, has one, short hash, hashes of all starts' strings).

    A cell has up to CELL neighbouring starts, aligned at the anchor, so equal strings lie in equal
    cells. Its long string covers the strings of all CELL starts, its short string is their overlap.
    """
    n = len(cnt)
    base = off[:-1] + left
    row = np.repeat(np.arange(n), np.diff(off))
    at = np.flatnonzero(_anchor_hashes(data) == a[row[: max(len(data) - ANCHOR + 1, 0)]])
    rel = at - base[row[at]]
    ok = (rel >= 0) & (rel <= length - ANCHOR)
    place = np.zeros(n, dtype=np.int64)
    np.maximum.at(place, row[at][ok], rel[ok])  # the anchor is its last occurrence in the first string
    low, high = (place - cnt + 1) // CELL, place // CELL
    size = high - low + 1
    ctx = np.repeat(np.arange(n), size)
    k = np.repeat(low, size) + np.arange(len(ctx)) - np.repeat(np.cumsum(size) - size, size)
    head = place[ctx] - CELL * k - (CELL - 1)  # the cell's first start, owned or not
    first = np.maximum(head, 0)
    owned = np.minimum(head + CELL, cnt[ctx]) - first
    begin = base[ctx] + head
    whole = (head >= -left[ctx]) & (begin + CELL - 1 + length <= off[1:][ctx])
    hl = np.zeros(len(ctx), dtype=np.uint64)
    hl[whole] = bk.span_hashes(data, begin[whole], begin[whole] + CELL - 1 + length)
    hs = bk.span_hashes(data, begin + CELL - 1, begin + length)
    start = np.repeat(base[ctx] + first, owned) + np.arange(owned.sum()) - np.repeat(np.cumsum(owned) - owned, owned)
    return ctx, k, first, owned, hl, whole, hs, bk.span_hashes(data, start, start + length)


def _spans_by_hash(contexts: DataFrame, length: int) -> DataFrame:
    """Covered spans of contexts of crowded anchors, by hashes that any number of tasks can share.

    If a cell's long string occurs twice, all its strings do; if its short string occurs once, none
    does. Only the cells between, at the edges of what is shared, have their strings counted one by
    one, against each other and against one cell of every repeated long string. Hashes have 64 bits
    and are compared within one anchor.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bk.text_buffers(batch.column(4))
            a = batch.column(0).to_numpy()
            ctx, k, first, owned, hl, whole, hs, fine = cells_of(data, off, batch.column(5).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64), a.view(np.uint64), length)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(owned)]).astype(np.int32)), pa.array(fine.view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(a[ctx]), pa.array(k.astype(np.int32)), pa.array(hl.view(np.int64), mask=~whole), pa.array(hs.view(np.int64)),
                pa.array(batch.column(1).to_numpy()[ctx]), pa.array((batch.column(2).to_numpy()[ctx] + first).astype(np.int32)), lists,
            ], names=_CELLS.names)

    cells = written(contexts.mapInArrow(run, _CELLS), "cells")
    long_ = written(cells.where("hl is not null").groupBy("a", "k", "hl").agg(F.count("*").alias("n"), F.min("hs").alias("hs"), F.min("fine").alias("fine")).where("n > 1"), "long")
    short = written(cells.groupBy("a", "k", "hs").agg(F.count("*").alias("n")).where("n > 1").select("a", "k", "hs", "n"), "short")
    whole = _in_groups(cells, long_, ["a", "k", "hl"]).select("key", "s", (F.col("s") + F.size("fine") - 1 + length).alias("e"))
    edges = written(_in_groups(_in_groups(cells, short, ["a", "k", "hs"]), long_, ["a", "k", "hl"], among=False), "edges")
    witness = long_.join(edges.select("a", "k", "hs").distinct(), ["a", "k", "hs"], "left_semi").select("a", F.lit(None).cast("long").alias("key"), F.lit(0).alias("s"), "fine")
    strings = edges.select("a", "key", "s", "fine").unionByName(witness).select("a", "key", "s", F.posexplode("fine").alias("i", "h"))
    strings = written(strings.select("a", "h", "key", (F.col("s") + F.col("i")).alias("s")), "strings")
    again = written(strings.groupBy("a", "h").agg(F.count("*").alias("n")).where("n > 1"), "repeated-strings")
    single = _in_groups(strings.where("key is not null"), again, ["a", "h"]).select("key", "s", (F.col("s") + length).alias("e"))
    return whole.unionByName(single)


def repeated_spans(texts: DataFrame, length: int = MIN_BYTES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Spans ``(key, s, e)`` of ``texts(key, text)`` that repeated strings cover; they may overlap.

    Equal strings own equal anchors, so only anchors that occur twice matter. If all contexts of an
    anchor are equal, every string in them repeats. Where they differ, one copy of each different
    context goes to a transform that tells which of its strings are shared. An anchor with more than
    ``group_limit`` different contexts has its strings counted by hash instead, which any number of
    tasks can share.
    """
    table = written(_anchor_table(texts, length), "anchors")
    twice = written(table.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "twice")
    shared = written(table.join(twice, "a"), "shared-anchors")
    different = written(shared.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "cnt")).alias("at")), "contexts")
    whole = _in_groups(shared, different.where("n > 1"), ["a", "c"]).select("key", F.col("lo").alias("s"), (F.col("lo") + F.col("cnt") - 1 + length).alias("e"))
    mixed = written(different.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "mixed")
    unclear = different.join(mixed, "a").select("a", "at.*", (F.col("m") > group_limit).alias("crowded"))
    by_doc = written(unclear.groupBy("key", "crowded").agg(F.collect_list(F.struct("a", "lo", "cnt")).alias("places")), "unclear")
    parts = [whole]
    for crowded in (False, True):
        lists = by_doc.where(F.col("crowded") == crowded).select("key", "places")
        contexts = _contexts(_to_texts(texts, lists, "inner", may_broadcast=crowded), length, CELL - 1 if crowded else 0)
        if crowded:
            parts.append(_spans_by_hash(contexts, length))
        else:
            n = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            parts.append(_spans_by_transform(contexts.repartition(n, "a").sortWithinPartitions("a"), length))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _merged(spans: DataFrame) -> DataFrame:
    """``(key, places)``: each document's spans, merged where they touch."""

    def merge(places: list[dict]) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for s, e in sorted((p["s"], p["e"]) for p in places):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [{"s": s, "e": e} for s, e in out]

    lists = spans.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("places"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([merge(x) for x in batch.column(1).to_pylist()], batch.schema.field(1).type)], names=["key", "places"])

    return lists.mapInArrow(run, lists.schema)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(own, key, text)``: the key is the id where ids are there and unique, else a hash of id and text."""
    rows = docs.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    plain = is_empty(rows.groupBy("own").agg(F.count("*").alias("n")).where("own is null or n > 1"))
    return rows.select("own", (F.col("own") if plain else F.xxhash64("own", "text")).alias("key"), "text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = MIN_BYTES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)`` of every row: kept has the bytes that no repeated string covers.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the
    same document or another (rows that repeat a document are other documents). Strings never cross
    documents and are judged on the input. Null text is empty; texts shorter than ``length`` stay.
    """
    texts = keyed_texts(docs, id_col, text_col)
    with scratch(docs.sparkSession), arrow_rows(docs.sparkSession, ARROW_ROWS):
        by_doc = written(_merged(repeated_spans(texts.select("key", "text"), length, group_limit)), "spans", keep=True)
    joined = _to_texts(texts, by_doc, "left", may_broadcast=True).select("own", "text", "s", "e")
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])

    def left(own: pa.Array, data: np.ndarray, off: np.ndarray, at: np.ndarray, until: np.ndarray) -> pa.RecordBatch:
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, until, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        removed = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(gone, out=removed[1:])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = off[:-1][off[:-1] < len(data)]
        begins[heads] = gone[heads]
        spans = np.searchsorted(np.flatnonzero(begins), off)
        kept, cut = data[~gone].tobytes(), off - removed[off]
        body = [kept[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([own, pa.array(np.diff(off)), pa.array(np.diff(removed[off])), pa.array(np.diff(spans)), pa.array(body, pa.binary())], names=out.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bk.text_buffers(batch.column(1))
            n, (begins, ends) = _places(batch, ["s", "e"])
            first = np.concatenate([[0], np.cumsum(n)])
            for a, b in bk.doc_chunks(off, TEXT_BYTES):
                mine = slice(first[a], first[b])
                base = np.repeat(off[a:b] - off[a], n[a:b])
                s, e = begins[mine], ends[mine]
                yield left(batch.column(0).slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a], base + s, base + e)
        bk.release_memory()

    return joined.mapInArrow(run, out)
