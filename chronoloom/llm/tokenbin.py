"""Token ids in a binary format of Re-Pair grammars, one per shard.

A shard holds whole documents. Its container has the rules, the expansion length of every rule, the
symbols, and for each document where its symbols begin, so that one document is decoded alone.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytekernel as bk
from .storage import ARROW_ROWS, arrow_rows

END_ID = 1
SHARD_TOKENS = 1 << 19
#: Texts are cut into pieces of about so many characters, at white space.
PIECE_CHARS = 1 << 20
#: Bytes of texts whose words are looked up together, and about how many the cache of words may take, of
#: which a word takes PIECE_BYTES besides its own and its ids'. The cache lives as long as its Python
#: worker, so that later tasks find the words of earlier ones.
CHUNK_BYTES, CACHE_BYTES, PIECE_BYTES = 8 << 20, 64 << 20, 80
MAGIC = b"RPG2"
#: By how much the least count of replaced pairs falls from round to round.
FALL = 32
_SCHEMA = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("body", T.BinaryType())])
_TAIL = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: Characters after which a text is encoded whole: Python takes them for white space, the tokenizer doesn't.
_CONTROLS = "\x1c\x1d\x1e\x1f"
#: White space beyond ASCII.
_WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _by_words(config: dict) -> bool:
    """Whether a vocabulary drops white space, lower-cases, and ends every word in a suffix."""
    normal = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
    cut = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        normal == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cut] == ["Split", "ByteLevel"] and config["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in cut[0]["pattern"].get("Regex", "") and not cut[1]["use_regex"] and bool(config["model"].get("end_of_word_suffix"))
    )


def _runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``size`` from ``start`` in ``flat`` one after the other, where each ends)."""
    stop = np.cumsum(size)
    at = np.repeat(start - stop + size, size)
    at += np.arange(len(at))
    return flat[at], stop


def _spread(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs ``which`` one after the other, where each ends), ``flat`` being runs of ``sizes``."""
    return _runs(flat, (np.cumsum(sizes) - sizes)[which], sizes[which])


def _strings(column: pa.StringArray, rows: np.ndarray) -> list[str]:
    return column.take(pa.array(rows)).to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts through the tokenizers library, each different word once.

    Where a vocabulary drops white space and never joins across it (``_by_words``), a text's ids are
    its words' ids one after the other. Texts are lower-cased as the library does it, letter by letter;
    the words of many texts are numbered by an Arrow dictionary, and the different ones are cut into
    pieces, which are looked up all at once among those of earlier texts. Only pieces not found there
    go through the library. A word of letters, with or without a run of ASCII punctuation after it, is
    one or two pieces to the library's BPE model; any other word goes through the whole tokenizer. A
    text that isn't in normal form C, or holds a special token or one of a few controls, is encoded
    whole, and so is every text with any other kind of vocabulary.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 0xFFFF else np.dtype("<u4")
        config = json.loads(vocabulary)
        self.by_words = _by_words(config)
        self.odd = [*_CONTROLS, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        self._remember(pa.array([""], pa.string()), np.zeros(0, self.kind), np.zeros(1, np.int64))
        if self.by_words:
            # the model alone, for pieces that are written as the model has them
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            suffix, known = config["model"]["end_of_word_suffix"], self.tokenizer.get_vocab()
            self.closes = np.zeros(max(known.values()) + 1, dtype=bool)
            self.closes[[i for word, i in known.items() if word.endswith(suffix)]] = True
            pieces = ByteLevel(add_prefix_space=False, use_regex=False)
            # how the library writes each byte; every byte occurs in some valid text but for those that no text holds
            self.byte_names = {b: pieces.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
            del self.byte_names[0x20]  # it stands between pieces
            for c in [chr(i) for i in range(0x80, 0x800)] + [chr(i << 12 | 0x0800 & 0xFFF) for i in range(16) if not 0xD <= i <= 0xD] + [chr(i << 16) for i in range(1, 17)]:
                for byte, name in zip(c.encode(), pieces.pre_tokenize_str(c)[0][0], strict=True):
                    self.byte_names[byte] = name

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _remember(self, pieces: pa.StringArray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Make the cache of ``pieces``, the empty one first, whose ids are runs of ``sizes`` in ``flat``."""
        self.known, self.flat, self.sizes = pieces, flat, sizes
        self.cached = pieces.nbytes + flat.nbytes + PIECE_BYTES * len(pieces)

    def _forget(self, used: np.ndarray) -> None:
        """Where the cache is over its bytes, it keeps only the pieces at ``used``, or none if those are too many."""
        if self.cached > CACHE_BYTES:
            used = np.append(0, used[used > 0])
            self._remember(self.known.take(pa.array(used)), _spread(self.flat, self.sizes, used)[0], self.sizes[used])
        if self.cached > CACHE_BYTES:
            self._remember(pa.array([""], pa.string()), self.flat[:0], self.sizes[:1])

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece), by the library's model."""
        parts = []
        for a in range(0, len(pieces), 512):
            names = " ".join(pieces[a : a + 512])
            if not names.isascii():
                names = names.encode().decode("latin-1").translate(self.byte_names)
            parts.append(np.array(self.model.encode_batch_fast([names], add_special_tokens=False)[0].ids, dtype=self.kind))
        ids = np.concatenate(parts) if parts else np.zeros(0, self.kind)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(pieces) or len(ids) and ends[-1] != len(ids):
            raise ValueError("the vocabulary does not end every word in its suffix")
        return ids, np.diff(ends, prepend=0)

    def _numbers(self, pieces: pa.StringArray) -> np.ndarray:
        """Where different pieces are in the cache, which takes in those that are new to it."""
        at = pc.index_in(pieces, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            where = np.flatnonzero(new)
            words = _strings(pieces, where)
            plain = np.fromiter((w.isalpha() or not w.rstrip(_TAIL) for w in words), bool, len(words))
            where = np.concatenate([where[plain], where[~plain]])
            flat, sizes = self._pieces([w for w, p in zip(words, plain.tolist(), strict=True) if p])
            odd = [self._whole(w) for w, p in zip(words, plain.tolist(), strict=True) if not p]
            flat = np.concatenate([self.flat, flat, np.frombuffer(b"".join(odd), dtype=self.kind)])
            sizes = np.concatenate([self.sizes, sizes, np.fromiter(map(len, odd), np.int64, len(odd)) // self.kind.itemsize])
            at[where] = len(self.known) + np.arange(len(where))
            self._remember(pa.concat_arrays([self.known, pieces.take(pa.array(where))]), flat, sizes)
        return at

    def _words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of different lower-cased words."""
        core = pc.ascii_rtrim(words, characters=_TAIL)
        letters = pc.ascii_is_alpha(core).to_numpy(zero_copy_only=False).copy()
        wide = np.flatnonzero(~pc.string_is_ascii(core).to_numpy(zero_copy_only=False))
        letters[wide] = [w.isalpha() for w in _strings(core, wide)]
        tailed = np.flatnonzero(letters & (pc.binary_length(core).to_numpy() < pc.binary_length(words).to_numpy()))
        tails = [w[len(c) :] for w, c in zip(_strings(words, tailed), _strings(core, tailed), strict=True)]
        heads = pc.if_else(pa.array(letters), core, words)
        pieces = pa.concat_arrays([heads, pa.array(["", *tails], pa.string())]).dictionary_encode()
        at = self._numbers(pieces.dictionary)
        number = at[pieces.indices.to_numpy()]
        pair = np.full((len(words), 2), number[len(words)])
        pair[:, 0] = number[: len(words)]
        pair[tailed, 1] = number[len(words) + 1 :]
        ids, stop = _spread(self.flat, self.sizes, pair.ravel())
        self._forget(at)
        return ids, np.diff(stop[1::2], prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        rows: list[str] = []
        owner: list[int] = []
        whole: dict[int, bytes] = {}
        for i, text in enumerate(texts):
            if not self.by_words or not text.isascii() and not unicodedata.is_normalized("NFC", text) or any(x in text for x in self.odd):
                whole[len(rows)] = self._whole(text)
                rows.append("")
                owner.append(i)
                continue
            text = text.replace("\u03a3", "\u03c3").lower()  # the library knows no final sigma
            at = 0
            while at < len(text) or not at:
                stop = at + PIECE_CHARS
                while stop < len(text) and not text[stop].isspace():
                    stop += 1
                rows.append(text[at:stop] if at or stop < len(text) else text)
                owner.append(i)
                at = stop
        column = pa.array(rows, pa.string())
        # the quicker split knows ASCII alone
        wide = pc.any(pc.match_substring_regex(column, _WIDE_SPACE)).as_py()
        words = pc.utf8_split_whitespace(column) if wide else pc.ascii_split_whitespace(column)
        numbered = words.flatten().dictionary_encode()
        ids, sizes = self._words(numbered.dictionary)
        out, stop = _spread(ids, sizes, numbered.indices.to_numpy())
        upto = np.concatenate([[0], stop])[words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()]
        counts = np.diff(upto)
        if whole:
            parts, done = [], 0
            for row, raw in whole.items():
                parts += [out[done : upto[row]], np.frombuffer(raw, dtype=self.kind)]
                done = upto[row]
                counts[row] = len(raw) // self.kind.itemsize
            out = np.concatenate([*parts, out[done:]])
        return out, np.bincount(np.array(owner, dtype=np.int64), counts, minlength=len(texts)).astype(np.int64)


def _occurrences(seq: np.ndarray, at: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, where each begins among the places, its count, places by pair) of the neighbours at ``at`` and after."""
    a, b = seq[at].astype(np.uint64), seq[at + 1].astype(np.uint64)
    if narrow:  # pair and place share a word, so one sort does both
        a <<= np.uint64(16)
        a |= b
        a <<= np.uint64(32)
        a |= at.astype(np.uint64)
        a.sort()
        place, pair = (a & np.uint64(0xFFFFFFFF)).astype(np.uint32), (a >> np.uint64(32)).astype(np.uint32)
    else:
        pair = a << np.uint64(32) | b
        order = np.argsort(pair, kind="stable")
        pair, place = pair[order], at[order].astype(np.uint32)
    begin = np.append(0, np.flatnonzero(pair[1:] != pair[:-1]) + 1) if len(pair) else np.zeros(0, np.int64)
    return pair[begin].astype(np.uint64), begin, np.diff(begin, append=len(pair)), place


def _apart(place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at ``place`` (ascending) are replaced: none overlap, and of neighbours the
    lower rank goes first; in a run of one rank every other one."""
    kept = np.zeros(len(place), dtype=bool)
    open_ = np.arange(len(place))
    for _ in range(8):  # what is still open then waits for the next round
        at, r = place[open_], rank[open_]
        touch = np.diff(at) == 1
        fresh = np.append(True, ~(touch & (r[1:] == r[:-1])))
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        now = since % 2 == 0
        now[1:] &= ~(touch & (r[:-1] < r[1:]))
        now[:-1] &= ~(touch & (r[1:] < r[:-1]))
        kept[open_[now]] = True
        beside = now.copy()
        beside[1:] |= touch & now[:-1]
        beside[:-1] |= touch & now[1:]
        open_ = open_[~beside]
        if not len(open_):
            break
    return kept


def compress(ids: np.ndarray, ends: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (symbols, number of symbols before each document and in all, rules).

    Frequent pairs of neighbours become nonterminals again and again until no pair pays, that is
    until none saves more bytes than its rule takes. A round replaces all pairs that occur at least as
    often as a bar, the most frequent first where they overlap; the bar falls by a factor of FALL
    until it is the least count that pays. From then on a round looks at pairs with a symbol of the
    round before, and where those give nothing, at all that may pay: pairs that did when all were last
    looked at, and pairs with a symbol made since (a pair of older ones does not become more frequent).
    Pairs never cross the document ends ``ends``. Symbol ``first_symbol + i`` stands for the pair ``rules[i]``. Symbols of 16 bits are
    not widened for the sake of more rules: two bytes more for every symbol is more than the pairs
    that are left save.
    """
    narrow = first_symbol < 0x10000
    width, limit = (2, 0x10000) if narrow else (4, 1 << 32)
    half = np.uint64(8 * width)
    pays = (2 * width + 2) // width + 1
    seq, ends = ids.astype(np.uint32), np.asarray(ends, dtype=np.int64)
    rules: list[np.ndarray] = []
    top, mark, bar = first_symbol, 0, len(seq)
    hot, since = None, 0  # where the pairs are that paid when all were looked at, the first symbol of that round
    while top < limit and len(seq) > 1:
        if mark or hot is not None:
            fresh = seq >= (mark or since)
            inner = fresh[:-1] | fresh[1:]
            if not mark:
                inner |= hot[:-1]
        else:
            inner = np.ones(len(seq) - 1, dtype=bool)
        inner[ends[:-1] - 1] = False
        pair, begin, count, place = _occurrences(seq, np.flatnonzero(inner), narrow)
        bar = max(pays, min(bar, int(count.max(initial=0))) // FALL)
        often = np.flatnonzero(count >= bar)
        often = often[np.argsort(-count[often], kind="stable")]
        if bar == pays and not mark:
            hot, since = np.zeros(len(seq), dtype=bool), top
            hot[_runs(place, begin[often], count[often])[0]] = True
        often = often[: limit - top]
        # by place, for which a sort of numbers that hold the rank too is quickest
        both = _runs(place, begin[often], count[often])[0].astype(np.uint64) << np.uint64(32)
        both |= np.repeat(np.arange(len(often), dtype=np.uint64), count[often])
        both.sort()
        at, rank = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        kept = np.flatnonzero(_apart(at, rank))
        at, rank = at[kept], rank[kept]
        worth = np.bincount(rank, minlength=len(often)) >= pays
        kept = np.flatnonzero(worth[rank])
        at, rank = at[kept], rank[kept]
        if not len(at):
            if bar == pays and not mark:
                break
            mark = 0
            continue
        seq[at] = top + (np.cumsum(worth) - 1)[rank]
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        seq = seq[stay]
        hot = hot if hot is None else hot[stay]
        ends = ends - np.searchsorted(at + 1, ends - 1, side="right")
        chosen = pair[often[worth]]
        rules.append(np.stack([chosen >> half, chosen & ((np.uint64(1) << half) - np.uint64(1))], axis=1).astype(np.int64))
        mark, top = top if bar == pays else 0, top + len(chosen)
    return seq, np.append(0, ends), np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def levels(rules: np.ndarray, first_symbol: int) -> list[np.ndarray]:
    """Rules by depth: those of a level are made of terminals and of rules of the levels before."""
    ready = np.zeros(first_symbol + len(rules), dtype=bool)
    ready[:first_symbol] = True
    out, left = [], np.arange(len(rules))
    while len(left):
        now = ready[rules[left, 0]] & ready[rules[left, 1]]
        if not now.any():
            raise ValueError("rules refer to each other in a circle")
        out.append(left[now])
        ready[first_symbol + left[now]] = True
        left = left[~now]
    return out


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    lengths = np.ones(first_symbol + len(rules), dtype=np.int64)
    for level in levels(rules, first_symbol):
        lengths[first_symbol + level] = lengths[rules[level, 0]] + lengths[rules[level, 1]]
    return lengths


def _width(values: np.ndarray) -> int:
    return 2 if values.max(initial=0) <= 0xFFFF else 4


def pack(ids: np.ndarray, ends: np.ndarray, first_symbol: int) -> bytes:
    """The container of one shard; ``ends`` has where each document ends in ``ids``."""
    symbols, starts, rules = compress(ids, ends, first_symbol)
    lengths = expansion_lengths(rules, first_symbol)[first_symbol:]
    wide, long = 2 if first_symbol + len(rules) <= 0x10000 else 4, _width(lengths)
    head = struct.pack("<4sBBIIII", MAGIC, wide, long, first_symbol, len(rules), len(ends), len(symbols))
    return b"".join([head, starts.astype("<u4").tobytes(), rules.astype(f"<u{wide}").tobytes(), lengths.astype(f"<u{long}").tobytes(), symbols.astype(f"<u{wide}").tobytes()])


class Shard:
    """A container opened for reading."""

    def __init__(self, body: bytes) -> None:
        magic, wide, long, self.first_symbol, n_rules, self.n_docs, n_symbols = struct.unpack_from("<4sBBIIII", body)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = struct.calcsize("<4sBBIIII")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        first = self.first_symbol
        self.starts = take("<u4", self.n_docs + 1).astype(np.int64)
        self.rules = take(f"<u{wide}", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths = np.concatenate([np.ones(first, np.int64), take(f"<u{long}", n_rules).astype(np.int64)])
        self.symbols = take(f"<u{wide}", n_symbols).astype(np.int64)
        # all expansions of nonterminals one after the other; a terminal is its own
        self.flat_at = np.cumsum(self.lengths) - self.lengths
        self.flat = np.empty(int(self.lengths.sum()), dtype=np.uint32)
        self.flat[:first] = np.arange(first)
        for level in levels(self.rules, first):
            for side in (0, 1):
                symbol = self.rules[level, side]
                n = self.lengths[symbol]
                to = self.flat_at[first + level] + (self.lengths[self.rules[level, 0]] if side else 0)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self.flat[np.repeat(to, n) + step] = self.flat[np.repeat(self.flat_at[symbol], n) + step]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.lengths[symbols]
        stop = np.cumsum(n)
        return self.flat[np.repeat(self.flat_at[symbols] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i`` alone."""
        return self._expand(self.symbols[self.starts[i] : self.starts[i + 1]])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ends of the documents)."""
        total = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])
        return self._expand(self.symbols), total[self.starts[1:]]


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    key = zlib.crc32(vocabulary.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, append ``end_id``, and write the shards under ``path``.

    Documents are in ascending order of the id (null first; equal ids by a hash of the text). Each
    range partition writes its own sequence of shards; ``start`` counts ids within the partition.
    Null text is an empty document, which has the end id alone.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, F.col("id")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary.value)
        first = enc.tokenizer.get_vocab_size()
        ids: list[np.ndarray] = []
        doc_ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        part, seq, start, held = 0, 0, 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, start, held
            body = pack(np.concatenate(ids), np.cumsum(np.concatenate(sizes)), first)
            own = pa.concat_arrays(doc_ids)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([body], pa.binary())],
                names=_SCHEMA.names,
            )
            seq, start, held = seq + 1, start + held, 0
            ids.clear(), doc_ids.clear(), sizes.clear()
            return out

        for batch in batches:
            if not len(batch):
                continue
            part = batch.column(2)[0].as_py()
            _, off = bk.text_buffers(batch.column(1))
            for a, b in bk.doc_chunks(off, CHUNK_BYTES):
                got, n = enc.encode(batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).tolist())
                got, n = np.insert(got, np.cumsum(n), end_id), n + 1
                stop = np.cumsum(n)
                done, x = 0, 0
                while x < b - a:  # a shard ends with the document that fills it
                    y = min(int(np.searchsorted(stop, done + shard_tokens - held)) + 1, b - a)
                    ids.append(got[done : stop[y - 1]])
                    sizes.append(n[x:y])
                    doc_ids.append(batch.column(0).slice(a + x, y - x))
                    held += int(stop[y - 1]) - done
                    done, x = int(stop[y - 1]), y
                    if held >= shard_tokens:
                        yield shard()
        if sizes:
            yield shard()
        bk.release_memory()

    with arrow_rows(spark, 4 * ARROW_ROWS):
        ordered.mapInArrow(run, _SCHEMA).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, decoded from the files under ``path``.

    start is the number of ids before the document in the whole order; the partitions' totals, one
    number each, are summed on the driver.
    """
    shards = spark.read.schema(_SCHEMA).parquet(path)
    before, total = {}, 0
    for r in sorted(shards.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).collect(), key=lambda r: r["part"]):
        before[r["part"]] = total
        total += r["n"]
    offsets = spark.sparkContext.broadcast(before)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, ends = Shard(batch.column(4)[i].as_py()).documents()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = offsets.value[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(i, 1).flatten(), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])
        bk.release_memory()

    return shards.select("part", "start", "n_tokens", "doc_ids", "body").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
