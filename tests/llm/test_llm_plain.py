"""The classifiers and the pipeline against plain re-implementations, odd column names, and very long texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_small import brute_contaminated, documents, five_word_sets, words

from chronoloom.llm import bytekernel as bk
from chronoloom.llm import decontam, langid, mixing, neardup, queries, simhash, suffixdedup, tokenbin, topk, toxicity, urlfilter, warc
from chronoloom.llm.storage import fresh_path

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


class PlainFtrl:
    """The update rule written out coordinate by coordinate."""

    def __init__(self, columns, alpha, l1, l2):
        self.columns, self.alpha, self.l1, self.l2 = columns, alpha, l1, l2
        self.z, self.n = defaultdict(float), defaultdict(float)

    def weight(self, f, c):
        z, n = self.z[f, c], self.n[f, c]
        if f == "bias":
            return -z * self.alpha / (1 + math.sqrt(n))
        if abs(z) <= self.l1:
            return 0.0
        return -(z - math.copysign(self.l1, z)) / ((1 + math.sqrt(n)) / self.alpha + self.l2)

    def learn(self, rows, epochs):
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for r in order.permutation(len(rows)):
                x, y = rows[r]
                x = {**x, "bias": 1.0}
                w = {(f, c): self.weight(f, c) for f in x for c in range(self.columns)}
                s = [sum(v * w[f, c] for f, v in x.items()) for c in range(self.columns)]
                if self.columns == 1:
                    g = [1 / (1 + math.exp(-s[0])) - y]
                else:
                    e = [math.exp(v - max(s)) for v in s]
                    g = [v / sum(e) - (c == y) for c, v in enumerate(e)]
                for f, v in x.items():
                    for c in range(self.columns):
                        old = self.n[f, c]
                        self.n[f, c] = old + (v * g[c]) ** 2
                        self.z[f, c] += v * g[c] - (math.sqrt(self.n[f, c]) - math.sqrt(old)) / self.alpha * w[f, c]

    def logits(self, x):
        return [sum(v * self.weight(f, c) for f, v in x.items()) + self.weight("bias", c) for c in range(self.columns)]


def plain_grams(text):
    codes = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else (ord(c) if c.isalpha() else 32) for c in text]
    out = Counter()
    for i in range(len(codes)):
        h = 0
        for k in range(min(langid.ORDERS, len(codes) - i)):
            h = (h ^ codes[i + k]) * 0x9E3779B1 & M32
            out[((h ^ h >> 15) * (0x85EBCA77 + 2 * k) & M32) >> 17] += 1
    return out


def learnable(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


@pytest.mark.parametrize("languages", [2, 3])
def test_language_scores_are_those_of_a_plain_version(spark, languages):
    kinds = {"de": ["wolf", "haus", "über", "und"], "fr": ["chat", "maison", "où", "et"], "es": ["gato", "casa", "niño", "y"]}
    names = list(kinds)[:languages]
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(kinds[names[i % languages]], k=r.randrange(1, 12)) + r.choices(sum(kinds.values(), []), k=r.randrange(3))), names[i % languages]) for i in range(240)]
    got = {x.id: x for x in langid.identify(documents(spark, rows)).collect()}
    learn = [x for x in rows if learnable(x[0])]
    df, n = Counter(f for _, t, _ in learn for f in plain_grams(t)), len(learn)
    order = sorted(set(x[2] for x in learn))
    idf = {f: (math.log((1 + n) / (1 + c)) + 1) * langid.SCALE for f, c in df.items()}

    def features(text):
        g = plain_grams(text)
        return {f: c / sum(g.values()) for f, c in g.items()}

    def key(x):
        f = sorted(features(x[1]).items())
        return x[2], np.array([a for a, _ in f], np.uint16).tobytes(), np.array([b for _, b in f], np.float32).tobytes()

    data = [({f: float(np.float32(v)) * idf[f] for f, v in features(x[1]).items()}, order.index(x[2])) for x in sorted(learn, key=key)]
    model = PlainFtrl(1 if languages == 2 else languages, 0.5, 0.02, 0.001)
    model.learn([x for i, x in enumerate(data) if i % 5], 3)
    held = data[::5]
    t = langid.temperature(np.array([model.logits(x) for x, _ in held]), np.array([y for _, y in held]))
    for i, text, _ in rows:
        s = [v / t for v in model.logits({f: v * idf[f] for f, v in features(text).items() if f in idf})]
        p = [1 - 1 / (1 + math.exp(-s[0])), 1 / (1 + math.exp(-s[0]))] if languages == 2 else [math.exp(v - max(s)) / sum(math.exp(u - max(s)) for u in s) for v in s]
        assert abs(max(p) - got[i].score) < 1e-3 and (got[i].lang_pred == order[p.index(max(p))] or abs(sorted(p)[-1] - sorted(p)[-2]) < 1e-3)


def plain_mix(h):
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & M64
    return h ^ h >> 32


def plain_word_grams(text):
    raw = bytes(32 if 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 else b for b in (text or "").encode())
    h = []
    for w in raw.lower().split():
        total = sum(int(bk._BYTE_CODE[b]) * pow(bk._BASE, i, 1 << 64) for i, b in enumerate(w))
        h.append(plain_mix((total + len(w) * 0x9E3779B97F4A7C15) & M64))
    out = {x >> 44 for x in h}
    for gap in (1, 2):
        out |= {plain_mix((a * 0x9E3779B97F4A7C15 + b * (2 * gap + 1)) & M64) >> 44 for a, b in zip(h, h[gap:], strict=False)}
    return out


def test_toxicity_scores_are_those_of_a_plain_version(spark):
    r = random.Random(3)
    rows = [(i, words(r.randrange(0, 30), i) + (" vile moron" if i % 4 == 0 else " kind moron" if i % 4 == 1 else "")) for i in range(300)]
    known = [(i, int(i % 4 == 0)) for i in range(260)]
    got = {x.id: x.score for x in toxicity.score_toxicity(documents(spark, rows), spark.createDataFrame(known, "doc_id long, toxic int"), l1=0.5).collect()}
    text = dict(rows)
    learn = sorted((y, np.array(sorted(plain_word_grams(text[i])), np.int32).tobytes(), i) for i, y in known if learnable(i))
    data = [(dict.fromkeys(plain_word_grams(text[i]), 1.0), y) for y, _, i in learn]
    model = PlainFtrl(1, 0.3, 0.5, 0.0)
    model.learn([x for i, x in enumerate(data) if i % 5], 2)
    held = data[::5]
    slope, shift = toxicity.platt(np.array([model.logits(x)[0] for x, _ in held]), np.array([y for _, y in held]), np.ones(len(held)))
    for i, t in rows:
        s = slope * model.logits(dict.fromkeys(plain_word_grams(t), 1.0))[0] + shift
        assert abs(1 / (1 + math.exp(-s)) - got[i]) < 2e-3


# --- names, sizes ----------------------------------------------------------------------------------

CLASHING = ["__row", "__a", "__b", "__parts", "a", "b", "row", "doc", "id", "fp", "component", "key", "n", "at", "words", "times", "v", "q", "best", "rank", "score", "payload", "digest", "host", "path", "keys", "rate", "y", "part", "seq", "a.b", "c`d"]


def clashing(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    for i, c in enumerate(CLASHING):
        if c not in df.columns:
            df = df.withColumn(c.replace("`", "``") if False else c, F.lit(f"x{i}"))
    return df


def test_columns_of_any_name_come_through(spark, tiny):
    import corpus_pipeline as cp

    rows = [(i, words(60, i // 2), "en", f"s{i % 2}", 9) for i in range(12)] + [(50, None, None, None, None), (51, "", "en", None, 0)]
    docs = clashing(spark, rows, "doc_id long, text string, lang string, source string, n_chars int")
    mine = {i: f"x{i}" for i, c in enumerate(CLASHING)}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all([x[c] for c in CLASHING] == list(mine.values()) for x in got), name
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == [0, 2, 4, 6, 8, 10, 50]
    assert len(langid.identify(docs).collect()) == len(mixing.mix_sizes(docs).collect()) == len(suffixdedup.remove_repeats(docs).collect()) == len(rows)
    bench = clashing(spark, [(1, words(60, 0))], "item_id long, text string")
    assert {r.id for r in decontam.contaminated(docs, bench).collect()} == {0, 1}
    vectors = clashing(spark, [(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert len(topk.top_k(vectors, F.col("vec_id") == 0).collect()) == 3
    pages = clashing(spark, [(1, "http://x.org/a", "<p>")], "page_id long, url string, html string")
    assert urlfilter.judge_urls(pages, queries.URL_RULES).first().verdict == "allow"
    path = fresh_path(spark, "t")
    warc.write_archive(pages, path)
    assert warc.read_index(spark, path).first().payload_bytes == 3
    labels = clashing(spark, [(1, 1), (2, 0)], "doc_id long, toxic int")
    assert len(toxicity.score_toxicity(docs, labels).collect()) == len(rows)
    out = fresh_path(spark, "t")
    tokenbin.write_tokens(docs, out, queries.vocabulary_path())
    assert tokenbin.read_tokens(spark, out).count() == len(rows)


def test_a_text_of_twenty_megabytes(spark, tmp_path):
    passage = words(90, 2)
    long = " ".join(words(5000, i % 40) for i in range(180)) + " " + passage
    long = (long * -(-20_000_000 // len(long)))[:20_000_000]
    docs = documents(spark, [(1, long, "en", "a"), (2, passage, "en", "a"), (3, words(50, 777), "de", "b")])
    assert {r.id for r in langid.identify(docs).collect()} == {1, 2, 3}
    assert {r.id for r in toxicity.score_toxicity(docs, spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")).collect()} == {1, 2, 3}
    assert simhash.near_duplicate_groups(docs).count() == 3
    assert neardup.similar_groups(docs).count() == 3
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert {r.id for r in decontam.contaminated(docs, bench).collect()} == {1, 2}
    sizes = {r.id: r.size for r in mixing.mix_sizes(docs).collect()}
    assert sizes[1] == len(long.split())
    out = fresh_path(spark, "t")
    tokenbin.write_tokens(docs, out, queries.vocabulary_path())
    assert {r.id for r in tokenbin.read_tokens(spark, out).collect()} == {1, 2, 3}
    cut = {r.id: (r.n_bytes, r.n_removed) for r in suffixdedup.remove_repeats(docs).select("id", "n_bytes", "n_removed").collect()}
    assert cut[1][0] == 20_000_000 and cut[2] == (len(passage), len(passage)) and cut[3][1] == 0 and cut[1][1] > 15_000_000


# --- the pipeline's stages -------------------------------------------------------------------------


def test_pipeline_stages_keep_what_their_contracts_say(spark, tiny):
    import corpus_pipeline as cp

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    base = words(200, 3).split()
    loose = [*base[:60], "changed", *base[61:140], "other", *base[141:]]
    rows = [(1, None), (2, ""), (3, "42 ..."), (4, " ".join(base)), (5, " ".join(loose)), (6, words(150, 9)), (6, words(150, 9)), (None, words(120, 10)), (7, words(30, 11) + " " + bench[0][1]), (8, "one"), (9, "One"), (10, words(3, 1)), (11, words(300, 12))]
    docs = documents(spark, [(i, t, "en", "ab"[(i or 0) % 2]) for i, t in rows])
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    first = cp.language_id(spark, docs, tiny)
    assert texts(first) == Counter((i, t) for i, t in rows if t and any(c.isalpha() for c in t))
    sets = five_word_sets([t for _, t in rows])
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, (i, t) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, (1 << 62, "")), (1 << 62 if i is None else i, t or ""))
    kept = texts(cp.near_dedup(spark, docs, tiny))
    assert sorted(i if i is not None else 1 << 62 for i, _ in kept) == sorted(i for i, _ in least.values()) and max(kept.values()) == 1
    bad = {i for i, _ in brute_contaminated(rows, bench)}
    assert bad == {7} and texts(cp.decontamination(spark, docs, tiny)) == Counter((i, t) for i, t in rows if i != 7)
    taken = {r.id: r for r in mixing.mix_sizes(docs).collect()}
    mixed = cp.source_mix(spark, docs, tiny).collect()
    for r in mixed:
        own = next(t for i, t in rows if i == r.doc_id)
        assert set(r.text.split()) <= set(own.split()) and len(r.text.split()) <= 3 * len(own.split()) and r.n_chars == len(r.text)
    assert abs(sum(len(r.text.split()) for r in mixed) - sum(r.taken for r in taken.values())) <= 400
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    got = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in cp.token_files(spark, docs, tiny).collect())
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in rows]
    assert got == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
