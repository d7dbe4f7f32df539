"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact verification."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType

from . import bytekernel as bk
from .storage import written

SHINGLE = 5
THRESHOLD = 0.8
#: Fingerprints of windows and items link at so many differing bits or fewer.
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
#: Benchmark text that one pass over the documents is compared with (it is broadcast).
BLOCK_BYTES = 8 << 20
_ONES = np.bitwise_count(np.arange(1 << BLOCK_BITS, dtype=np.uint16))

Hit = tuple[int, int, int, int, int, float]  # document, item, first word, words, differing bits, similarity


def meeting(a: np.ndarray, b: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in two lists of block values that differ by one of ``masks``.

    The longer list is put in order of its values, with a table of where each value begins; every value
    of the shorter one is looked up there with every mask.
    """
    if len(a) > len(b):
        j, i = meeting(b, a, masks)
        return i, j
    order = np.argsort(b, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=1 << BLOCK_BITS))])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for x in range(0, len(a), 1024):
        values = (a[x : x + 1024, None] ^ masks).ravel().astype(np.int64)
        n = begin[values + 1] - begin[values]
        hit = np.flatnonzero(n)
        n = n[hit]
        at = np.repeat(begin[values[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        found.append((np.repeat(hit // len(masks) + x, n), order[at]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


@dataclass
class SizeGroup:
    """The items of one number of words, with a multi-index over 16-bit blocks of fingerprints.

    A fingerprint within the radius of an item's differs in at most radius // 4 bits in one of the
    four blocks, so looking up all values so near in each block finds every pair within the radius. Of
    unrelated fingerprints about 4 in 100 meet at radius 15.
    """

    words: int
    shingle: int
    items: np.ndarray
    prints: np.ndarray
    bags: list[Counter]
    radius: int = RADIUS

    def __post_init__(self) -> None:
        self.shingles = self.words - self.shingle + 1
        self.masks = np.flatnonzero(_ONES <= self.radius // BLOCKS).astype(np.uint16)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, position in the group, distance) of all pairs within the radius."""
        asked, own = (x.view(np.uint16).reshape(-1, BLOCKS) for x in (prints, self.prints))
        met = [meeting(asked[:, k], own[:, k], self.masks) for k in range(BLOCKS)]
        pair = np.unique(np.concatenate([w * len(self.items) + i for w, i in met]))
        w, i = pair // len(self.items), pair % len(self.items)
        d = np.bitwise_count(prints[w] ^ self.prints[i])
        ok = d <= self.radius
        return w[ok], i[ok], d[ok]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def bag(words: list[bytes], size: int) -> Counter:
    return Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def _word_list(w: bk.Words, a: int, b: int) -> list[bytes]:
    raw = w.lower.tobytes() if len(w.lower) < 1 << 16 else None
    if raw is None:
        lo = int(w.starts[a]) if b > a else 0
        raw, shift = w.lower[lo : int(w.ends[b - 1]) if b > a else 0].tobytes(), lo
    else:
        shift = 0
    return [raw[s - shift : e - shift] for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]


class ItemIndex:
    """A block of benchmark items, grouped by number of words."""

    def __init__(self, texts: list[str | None], size: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS) -> None:
        self.size, self.threshold = size, threshold
        by_words: dict[int, list[tuple[int, int, Counter]]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        self.hashed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, text in enumerate(texts):
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            w = bk.words_of(data, np.array([0, len(data)]))
            n = len(w.starts)
            if not n:
                continue
            k = min(size, n)
            h = bk.shingle_hashes(bk.span_hashes(w.lower, w.starts, w.ends), k)
            fp = bk.simhash_bits(bk.bit_counts(h, np.array([0, len(h)])), np.array([len(h)]))[0]
            by_words.setdefault(n, []).append((i, fp, bag(_word_list(w, 0, n), k)))
            hashes.setdefault(k, []).append(h)
            self.hashed[i] = np.unique(h, return_counts=True)
        self.groups = [SizeGroup(n, min(size, n), np.array([x[0] for x in got]), np.array([x[1] for x in got], dtype=np.uint64), [x[2] for x in got], radius) for n, got in sorted(by_words.items())]
        self.known = {k: np.unique(np.concatenate(h)) for k, h in hashes.items()}
        self.filters = {}
        for k, known in self.known.items():
            bits = np.zeros(1 << 22, dtype=bool)
            bits[known >> np.uint64(42)] = True
            self.filters[k] = bits

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[Hit]:
        """The best window of every document for every item it holds at the threshold."""
        w = bk.words_of(data, offsets)
        out: list[Hit] = []
        if not len(w.starts):
            return out
        word_hash = bk.span_hashes(w.lower, w.starts, w.ends)
        for k, known in self.known.items():
            h = bk.shingle_hashes(word_hash, k)
            maybe = np.flatnonzero(self.filters[k][h >> np.uint64(42)])
            if not len(maybe):
                continue
            at = np.searchsorted(known, h[maybe])
            maybe = maybe[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == h[maybe])]
            doc = np.searchsorted(w.first, maybe, side="right") - 1
            inside = maybe + k <= w.first[doc + 1]
            hits, doc = maybe[inside], doc[inside]
            if not len(hits):
                continue
            total = np.zeros(len(h) + 1, dtype=np.int32)
            total[hits + 1] = 1
            np.cumsum(total, out=total)
            docs = np.unique(doc)
            for g in self.groups:
                if g.shingle == k:
                    out += self._best(g, w, h, *self._windows(g, w, total, docs))
        return out

    def _windows(self, g: SizeGroup, w: bk.Words, total: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, numbers of shingles) of the windows that are worth a fingerprint.

        A window of as many shingles as the item reaches the threshold t only if at least 2t / (1 + t)
        of them are shingles of the benchmark; ``total`` counts those before each place. In memory
        there is one flag for each word, however long the item and however common its passages.
        """
        m = g.shingles
        least = math.ceil(2 * self.threshold / (1 + self.threshold) * m - 1e-9)
        starts = np.flatnonzero(total[m:] - total[:-m] >= least) if len(total) > m else np.zeros(0, np.int64)
        starts = starts[starts + g.words <= w.first[np.searchsorted(w.first, starts, side="right")]]
        # a document shorter than the item is one window
        short = docs[w.first[docs + 1] - w.first[docs] < g.words]
        own = w.first[short + 1] - w.first[short] - g.shingle + 1
        known = total[w.first[short + 1] - g.shingle + 1] - total[w.first[short]]
        enough = known >= self.threshold * m
        return np.concatenate([starts, w.first[short[enough]]]), np.concatenate([np.full(len(starts), m), own[enough]])

    def _best(self, g: SizeGroup, w: bk.Words, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[Hit]:
        """Windows within the radius of an item are compared by the hashes of their shingles, and the
        best for each document and item by the words themselves."""
        found: dict[tuple[int, int], list[tuple[float, int, int, int]]] = {}
        rows = max(1, (1 << 19) // max(g.shingles, 1))  # shingles of so many windows are held at once
        for a in range(0, len(starts), rows):
            s, n = starts[a : a + rows], sizes[a : a + rows]
            first = np.concatenate([[0], np.cumsum(n)])
            flat = h[np.arange(first[-1]) - np.repeat(first[:-1] - s, n)]
            prints = bk.simhash_bits(bk.bit_counts(flat, first), n)
            for x, i, d in zip(*(v.tolist() for v in g.candidates(prints)), strict=True):
                value = self._alike(g, i, flat[first[x] : first[x + 1]])
                if value >= self.threshold:
                    doc = int(np.searchsorted(w.first, s[x], side="right") - 1)
                    found.setdefault((doc, i), []).append((-value, int(s[x]), int(n[x]) + g.shingle - 1, d))
        for (doc, i), windows in found.items():
            for _, at, words, d in sorted(windows):
                value = similarity(bag(_word_list(w, at, at + words), g.shingle), g.bags[i])
                if value >= self.threshold:
                    yield doc, int(g.items[i]), at - int(w.first[doc]), words, d, value
                    break

    def _alike(self, g: SizeGroup, i: int, shingles: np.ndarray) -> float:
        """Weighted Jaccard similarity of a window and an item, by hashes."""
        kinds, counts = self.hashed[int(g.items[i])]
        at = np.minimum(np.searchsorted(kinds, shingles), len(kinds) - 1)
        shared = int(np.minimum(np.bincount(at[kinds[at] == shingles], minlength=len(kinds)), counts).sum())
        return shared / max(len(shingles) + int(counts.sum()) - shared, 1)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, options: dict) -> Iterator[tuple[list, ItemIndex]]:
    """(item ids, index) of blocks of the benchmark of about BLOCK_BYTES each."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(n):
        got = sorted(items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect(), key=lambda r: (r["id"] is None, r["id"], r["text"]))
        if got:
            yield [r["id"] for r in got], ItemIndex([r["text"] for r in got], **options)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """``(id, item_id, first_word, words, distance, similarity)`` for each document and item it holds.

    A window has as many words as the item (a shorter document is one window). It counts if its
    SimHash over shingles of five words (an item of fewer words is one shingle) is within the radius
    of the item's and the weighted Jaccard similarity of their shingle bags is 0.8 or more; the best
    window is reported, the first of equals. Null and empty texts and items hold nothing. Rows that
    repeat a document id are searched each; items are compared block by block.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([
        T.StructField("id", source.schema["id"].dataType), T.StructField("item_id", item_type), T.StructField("first_word", T.LongType()),
        T.StructField("words", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("similarity", T.DoubleType()),
    ])
    found = None
    for ids, index in _blocks(benchmark, item_col, item_text, options):
        shared = docs.sparkSession.sparkContext.broadcast((ids, index))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            for batch in batches:
                data, off = bk.text_buffers(batch.column(1))
                hits = [(a + x[0], *x[1:]) for a, b in bk.doc_chunks(off) for x in index.find(data[off[a] : off[b]], off[a : b + 1] - off[a])]
                hits.sort(key=lambda x: x[:2])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([x[0] for x in hits], pa.int64())), pa.array([ids[x[1]] for x in hits], item_arrow),
                    pa.array([x[2] for x in hits], pa.int64()), pa.array([x[3] for x in hits], pa.int64()), pa.array([x[4] for x in hits], pa.int32()), pa.array([x[5] for x in hits], pa.float64()),
                ], names=schema.names)
            bk.release_memory()

        from pyspark.sql.pandas.types import to_arrow_type

        item_arrow = to_arrow_type(item_type)
        part = source.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (see ``contaminated``), with all their columns,
    whatever their names. Only the texts go to Python; a verdict per row comes back."""
    for n, (_, index) in enumerate(_blocks(benchmark, item_col, item_text, options)):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def free(texts: Iterator[pa.Array], shared=shared) -> Iterator[pa.Array]:
            for text in texts:
                data, off = bk.text_buffers(text)
                keep = np.ones(len(text), dtype=bool)
                for a, b in bk.doc_chunks(off):
                    keep[[a + x[0] for x in shared.value.find(data[off[a] : off[b]], off[a : b + 1] - off[a])]] = False
                yield pa.array(keep)
            bk.release_memory()

        if n and n % 4 == 0:  # a stage holds the indexes of four blocks at most
            docs = written(docs, "clean")
        docs = docs.where(F.arrow_udf(free, "boolean", ArrowUDFType.SCALAR_ITER)(F.col(text_col).cast("string")))
    return docs
