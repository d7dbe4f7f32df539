"""Small cases of every operator against brute force: nulls, empties, ties, repeats, extra columns."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from chronoloom.llm import bytekernel as bk
from chronoloom.llm import components, decontam, ftrl, langid, mixing, neardup, queries, simhash, suffixdedup, tokenbin, topk, toxicity, urlfilter, warc
from chronoloom.llm.storage import fresh_path
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, text2 string, count long, row string, key string"


def documents(spark, rows):
    """(doc_id, text[, lang[, source]]) with extra columns whose names the operators use themselves."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), "x", "y", 1, "r", "k") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n))


# --- 1: WARC -----------------------------------------------------------------------------------


def archive(spark, rows):
    path = fresh_path(spark, "t")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload string"), path)
    return path


def test_warc_round_trip_and_revisits(spark):
    long = "é" * 60
    rows = [(3, "http://a/x", long), (1, "u\r\nWARC-Type: bad", long), (2, None, long), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", long), (1, "u", long)]
    path = archive(spark, [(*r, "x", "y") for r in rows])
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_index(spark, path).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    least = 1
    want = []
    for i, _, t in rows:
        response = len((t or "").encode()) < 100 or i == least
        want.append((i, len((t or "").encode()), sha(t), "response" if response else "revisit", None if response else least))
    assert got == sorted(want, key=repr)
    records = {(r.id, r.record_type): r for r in warc.read_records(spark, path).collect()}
    r = records[3, "revisit"]
    assert bytes(r.payload).decode() == long and r.header.startswith("WARC/1.1\r\nWARC-Type: revisit\r\n") and r.refers_to == 1
    assert bytes(records[6, "response"].record).endswith(b"\r\n\r\nshort\r\n\r\n")
    assert spark.read.parquet(f"{path}/payloads").count() == 3


def test_warc_empty_and_tampered(spark):
    path = archive(spark, [])
    assert warc.read_index(spark, path).count() == 0
    path = archive(spark, [(1, "u", "hello", "", "")])
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"HELLO"))
    rows = bad.collect()
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match digest"):
        warc.read_index(spark, path).collect()


# --- 2 and 5: classifiers ------------------------------------------------------------------------


def test_language_learns_and_handles_odd_rows(spark):
    a, b = (lambda i: " ".join(random.Random(i).choices(["wolf", "haus", "über"], k=20))), (lambda i: " ".join(random.Random(i).choices(["chat", "maison", "où"], k=20)))
    rows = [(i, a(i) if i % 2 else b(i), "de" if i % 2 else "fr") for i in range(300)]
    odd = [(1000, None, "de"), (1001, "", None), (1002, "123 !?", "fr"), (1003, "WOLF ÜBER HAUS", None), (None, "maison", None), (1003, "WOLF ÜBER HAUS", None)]
    got = langid.identify(documents(spark, rows + odd)).collect()
    assert len(got) == 306
    by = {r.id: r for r in got}
    assert by[1000].lang_pred == by[1001].lang_pred == by[1002].lang_pred == "und" and by[1002].score == 0
    assert by[1003].lang_pred == "de" and by[None].lang_pred == "fr"
    assert all(by[i].lang_pred == ("de" if i % 2 else "fr") and 0 <= by[i].score <= 1 for i in range(300))


def test_language_without_labels_and_one_language(spark):
    assert [r.lang_pred for r in langid.identify(documents(spark, [(1, "abc", None)])).collect()] == ["und"]
    assert langid.identify(documents(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.identify(documents(spark, [(i, "abc", "en") for i in range(20)])).collect()} == {"en"}


def test_ngrams_stay_in_documents():
    texts = ["", "é", "ab", "AbÇ d"]
    enc = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in enc])])
    together, at, letter = langid.ngram_buffers(data, off)
    assert letter.tolist() == [False, True, True, True] and at.tolist() == [0, 0, 1, 3, 8]
    for i, e in enumerate(enc):
        alone, _, _ = langid.ngram_buffers(np.frombuffer(e, np.uint8), np.array([0, len(e)]))
        assert (together[:, at[i] : at[i + 1]] == alone).all()


def test_toxicity_finds_planted_words(spark):
    rows = [(i, words(60, i) + (" moron" if i % 3 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "z") for i in range(400)] + [(None, 1, "z"), (5, None, "z"), (3, 1, "z")], "doc_id long, toxic int, text string")
    docs = documents(spark, [*rows, (1000, None), (1001, ""), (None, "moron"), (1002, "MORON! " + words(30, 7))])
    got = {r.id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(400)) and got[1002] >= 0.5 and got[1001] < 0.5 and got[1000] == got[1001]
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, empty).collect()} == {0.0}
    assert toxicity.score_toxicity(documents(spark, []), labels).count() == 0


def test_ftrl_is_sparse_and_temperature_calibrates():
    r = np.random.default_rng(0)
    rows = [(np.unique(np.append(r.integers(1, 50, 5), [0] if y else [])).astype(int), None, int(y)) for y in r.integers(0, 2, 400)]
    rows = [(i, np.ones(len(i)), y) for i, _, y in rows]
    w, _ = ftrl.Ftrl(50, 2, alpha=0.3, l1=3.0).learn(rows, 3).weights()
    assert w[0, 0] > 1 and (w[1:] == 0).any() and np.abs(w[1:]).max() < w[0, 0] / 5
    z = r.normal(size=(2000, 1))
    y = (r.random(2000) < 1 / (1 + np.exp(-z[:, 0]))).astype(int)
    assert abs(ftrl.temperature(z * 4, y) - 4) < 1


# --- 3: decontamination --------------------------------------------------------------------------


def brute_contaminated(docs, items, k=5, least=0.8):
    out = set()
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            if not v or not w:
                continue
            s = min(k, len(v))
            n = min(len(v), len(w))
            bag = lambda x: Counter(tuple(x[j : j + s]) for j in range(len(x) - s + 1))
            for a in range(len(w) - n + 1):
                if n >= s and decontam.similarity(bag(w[a : a + n]), bag(v)) >= least:
                    out.add((d, i))
                    break
    return out


def test_decontamination_matches_brute_force(spark):
    items = [(1, words(30, 1)), (2, words(50, 2)), (3, "One Two three"), (4, None), (5, ""), (6, words(30, 1)), (7, "a a a a a a a a")]
    edit = items[1][1].split()
    edit[40] = "zzz"
    docs = [(1, words(40, 9) + "\n" + items[0][1].upper() + " " + words(10, 8)), (2, " ".join(edit)), (3, "x one  two\tTHREE y"), (4, None), (5, ""), (6, words(200, 3)), (7, " ".join(items[0][1].split()[:27])), (8, "a " * 20), (None, items[0][1]), (1, items[0][1])]
    bench = spark.createDataFrame([(*i, 0, 0) for i in items], "item_id long, text string, id long, doc_id long")
    got = {(r.id, r.item_id) for r in decontam.contaminated(documents(spark, docs), bench).collect()}
    assert got == brute_contaminated(docs, items) and (2, 2) in got and (1, 1) in got
    left = {r.doc_id for r in decontam.clean(documents(spark, docs), bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}
    none = bench.where("false")
    assert decontam.contaminated(documents(spark, docs), none).count() == 0 and decontam.clean(documents(spark, docs), none).count() == len(docs)
    assert decontam.contaminated(documents(spark, []), bench).count() == 0


def test_multi_index_finds_all_within_radius():
    r = np.random.default_rng(1)
    prints = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    g = decontam.SizeGroup(10, 5, np.arange(40), prints, [Counter()] * 40, radius=20)
    asked = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    w, i, d = g.candidates(asked)
    want = {(a, b) for a in range(200) for b in range(40) if (int(asked[a]) ^ int(prints[b])).bit_count() <= 20}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == want


# --- 4: SimHash ----------------------------------------------------------------------------------


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(ids, prints):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low.setdefault(find(i), []).append(d)
    return {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}, [find(i) for i in range(len(ids))]


@pytest.mark.parametrize("limit", [128, 2])
def test_simhash_groups_match_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (2, limit))
    base = words(80, 5)
    texts = [base, base.upper(), base.replace("a", "a", 1), None, "", "  \t", "one", "One", "ü" * 50, words(3000, 6)]
    for i in range(40):
        w = base.split()
        w[i % len(w)] = "changed"
        texts.append(" \n".join(w))
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, base), (7, "solo words here now"), (7, "solo words here now")]
    got = simhash.near_duplicate_groups(documents(spark, rows)).collect()
    assert Counter(r.id for r in got) == Counter(d for d, _ in rows)
    prints = [brute_print(t) for _, t in rows]
    low, root = brute_groups([d for d, _ in rows], prints)
    want = Counter((d, p, low[root[i]]) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
    assert Counter((r.id, r.fp & 0xFFFFFFFFFFFFFFFF, r.component) for r in got) == want


def test_simhash_empty_and_keep_one(spark):
    assert simhash.near_duplicate_groups(documents(spark, [])).count() == 0
    a = words(50, 1)
    docs = documents(spark, [(5, a), (3, a.upper()), (9, words(50, 2)), (9, words(50, 2)), (None, words(50, 3)), (1, None), (2, "")])
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "9", "None"]


def five_word_sets(texts):
    split = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for w in split]


@pytest.mark.parametrize("reach", [32, 4, 1])
def test_similar_groups_match_brute_force(spark, reach):
    r = random.Random(8)
    texts = [None, "", "one", "One", "two words", words(400, 9)]
    for seed, copies in ((1, 25), (2, 6), (3, 1)):
        base = words(150, seed).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(7)):
                w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
            texts.append(" ".join(w))
    sets = five_word_sets(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = neardup.similar_groups(documents(spark, list(enumerate(texts))), reach=reach).collect()
    assert {x.id: x.component for x in got} == {i: find(i) for i in range(len(texts))}


def test_bk_tree_finds_the_nearest_that_fit():
    r = random.Random(5)
    values = [r.getrandbits(64) for _ in range(60)]
    values += [v ^ (1 << r.randrange(64)) for v in values for _ in range(3)] + values[:9]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in [*values[:40], 0, (1 << 64) - 1]:
        for count in (1, 2, 7, 1000):
            got = tree.nearest(q, count, lambda at: at % 3 > 0)
            want = sorted((q ^ v).bit_count() for at, v in enumerate(values) if at % 3)[:count]
            assert [(q ^ values[at]).bit_count() for at in got] == want
            assert len(set(got)) == len(got) and all(at % 3 for at in got)


@pytest.mark.parametrize("limit", [256, 8])
def test_trees_of_lists_pair_the_nearest_and_name_what_is_left(limit):
    r = random.Random(6)
    rows = [(s, 100 * s + i, 20, 0, r.getrandbits(64) - (1 << 63), 100 * s + i) for s, size in enumerate((1, 2, 3, 40)) for i in range(size)]
    got = list(neardup.tree_pairs(rows, 0.8, 2, limit))
    pairs = [(u, v) for u, v, s in got if s is None]
    assert [s for _, _, s in got if s is not None] == [3]  # lists of three are whole
    assert {p for p in pairs if p[0] < 300} == {(100, 101), (200, 201), (200, 202), (201, 202)}
    sims = {row[1]: row[4] & (1 << 64) - 1 for row in rows}
    assert len(pairs) == len(set(pairs))
    if limit == 256:
        assert len(pairs) == 4 + 2 * 40 - 3
        for i in range(302, 340):
            two = sorted((sims[i] ^ sims[j]).bit_count() for j in range(300, i))[:2]
            assert sorted((sims[i] ^ sims[u]).bit_count() for u, v in pairs if v == i) == two
    joined = [(*row[:5], 1) if row[0] == 3 and row[1] < 339 else row for row in rows]
    left = [(u, v) for u, v, s in neardup.tree_pairs(joined, 0.8, 2, limit) if s is None and u >= 300]
    assert len(left) == 2 and all(v == 339 for _, v in left)
    assert not list(neardup.tree_pairs([(0, i, 20, 17, 0, i) for i in range(3)], 0.8, 2, limit))  # too little left after the shared shingle


def test_near_copies_are_proposed_by_simhash(spark):
    """Of a cluster in which most texts are too far apart, the first round already links each pair of close ones."""
    r = random.Random(9)
    base, texts = words(150, 1).split(), []
    for i in range(30):
        w = list(base)
        for at in r.sample(range(10, 150, 7), 8):
            w[at] = f"x{i}at{at}"
        texts += [" ".join(w), " ".join([*w[:-1], f"last{i}"])]
    order = r.sample(range(60), 60)
    docs = documents(spark, [(order[i], t) for i, t in enumerate(texts)]).selectExpr("doc_id as id", "text")
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    prints = neardup._prints(docs, none, 0.8, 5).cache()
    sets = neardup.shingle_sets(*text_arrays(texts))
    sims = {x.id: x.sim for x in prints.collect()}
    for i, s in enumerate(sets):
        ones = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        assert sims[order[i]] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * int(ones[b]) > len(s))
    postings = prints.selectExpr("fp", "n", "sim", "posexplode(prefix) as (pos, s)")
    pairs = {(x.u, x.v) for x in neardup._near_in_lists(postings, 0.8, 2).where("s is null").collect()}
    fps = {x.id: x.fp for x in prints.collect()}
    twins = {tuple(sorted((fps[order[i]], fps[order[i + 1]]))) for i in range(0, 60, 2)}
    assert twins <= pairs


def test_pipeline_removes_loose_copies(spark, tiny):
    import corpus_pipeline as cp

    base = words(200, 3).split()
    loose = [*base[:60], "changed", *base[61:140], "other", *base[141:]]  # similarity 0.90
    a, b = simhash.fingerprint_buffers(*text_arrays([" ".join(base), " ".join(loose)]))
    assert (int(a) ^ int(b)).bit_count() > 2
    docs = documents(spark, [(4, " ".join(loose)), (2, " ".join(base)), (3, words(200, 4))])
    assert sorted(x.doc_id for x in cp.near_dedup(spark, docs, tiny).collect()) == [2, 3]


def text_arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_bk_tree_within_radius():
    r = random.Random(2)
    values = {r.getrandbits(64) for _ in range(200)}
    values |= {v ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for v in list(values)[:50]}
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in list(values)[:60]:
        assert sorted(tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == 200 and len(got) == 73
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_xxh64_of_all_lengths():
    data = np.frombuffer(random.Random(0).randbytes(5000), np.uint8)
    starts, lens = np.arange(0, 300), np.arange(0, 300)
    got = bk.xxh64(data, starts, lens, 42)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts, lens, strict=True)]


# --- 6: mixing -----------------------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix_targets_and_limits(spark):
    r = random.Random(4)
    rows = [(i, words(r.randint(0, 400), i), "en", r.choice(["a", "a", "a", "b", "c", None, "é"])) for i in range(300)] + [(900, words(30, 1), "en", "tiny"), (901, None, "en", "none"), (902, "  ", "en", "a"), (5, words(10, 3), "en", "a"), (None, words(50, 2), "en", "b"), (5, words(10, 3), "en", "a")]
    got = mixing.mix_sizes(documents(spark, rows)).collect()
    again = mixing.mix_sizes(documents(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    by_size = {}
    for g in got:
        by_size.setdefault((g.source_size, round(g.target, 6)), 0)
        by_size[g.source_size, round(g.target, 6)] += g.taken
        assert g.taken <= 3 * g.size
    assert Counter((sizes[s], round(want[s], 6)) for s in sizes) == Counter(by_size.keys())
    assert all(abs(taken - target) <= 130 + 0.05 * target for (_, target), taken in by_size.items())
    assert mixing.mix_sizes(documents(spark, [])).count() == 0


def test_mixed_documents_have_the_taken_words(spark):
    rows = [(i, words(150, i), "en", "ab"[i % 2]) for i in range(60)] + [(60, None, "en", "a")]
    docs = documents(spark, rows)
    sizes = {r.id: r for r in mixing.mix_sizes(docs).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    mixed = {r.doc_id: r for r in out.collect()}
    total = sum(len(r.text.split()) for r in mixed.values())
    assert abs(total - sum(s.taken for s in sizes.values())) < 0.1 * total
    for i, r in mixed.items():
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(rows[i][1].split()) and len(r.text.split()) <= 450
    assert mixing.mix_documents(documents(spark, [])).count() == 0


def test_repeated_rows_are_mixed_each(spark):
    rows = [(i, words(150, i), "en", "ab"[i % 2]) for i in range(30)]
    docs = documents(spark, [*rows, *rows, *rows])
    taken = sum(r.taken for r in mixing.mix_sizes(docs).collect())
    mixed = mixing.mix_documents(docs).collect()
    assert abs(sum(len(r.text.split()) for r in mixed) - taken) < 0.1 * taken
    assert max(Counter(r.doc_id for r in mixed).values()) > 1


# --- 7: token files ------------------------------------------------------------------------------


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    t = Tokenizer.from_file(path)
    texts = ["Hello, wörld! it's", None, "", "a\x1cb <|endoftext|> c", "ΣΑΣ e\u0301  x\u3000y", words(2000, 1), "1234 " * 50, "\U0001f600 hi", "ab" * 3000]
    rows = [(10 - i, x) for i, x in enumerate(texts)] + [(None, "null id"), (5, "same id"), (2**40, "far")]
    out = fresh_path(spark, "tok")
    tokenbin.write_tokens(documents(spark, rows).repartition(3), out, path, shard_tokens=500)
    got = sorted(((r.id is not None, r.id or 0, r.start, r.n_tokens, r.ids_crc32, r.id) for r in tokenbin.read_tokens(spark, out).collect()), key=lambda r: r[2])
    assert [r[:2] for r in got] == sorted(r[:2] for r in got)
    at, crc = 0, Counter()
    for _, _, start, n, c, i in got:
        assert start == at
        at += n
        crc[i, n, c] += 1
    want = Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert crc == want
    empty = fresh_path(spark, "tok")
    tokenbin.write_tokens(documents(spark, []), empty, path)
    assert tokenbin.read_tokens(spark, empty).count() == 0


def test_ids_are_the_librarys_on_every_code_point_and_on_mixtures():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    t, enc = Tokenizer.from_file(path), tokenbin.Encoder(open(path, encoding="utf-8").read())
    assert enc.by_words
    points = [chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) not in ("Cs", "Cn", "Co")]
    texts = ["".join(f"a{c}b {c}x{c} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    r = random.Random(4)
    odd = [*"abcXYZ09 \t\n.,!'-<|>@_", "\u0130", "\u03a3", "\u03c3", "\u0301", "\u0307", "\u0323", "\u00e9", "\u1e9e", "\u00df", "\u4e2d", "\u3000", "\u0085", "\u200b", "\u01c5", "\U0001f600", "don't", "<|endoftext|>", "\x1c"]
    texts += ["".join(r.choices(odd, k=r.randint(0, 40))) for _ in range(6000)] + ["\u0130stanbul", "", " ", "x" * 3000, "\u0130" * 50]
    got, n = enc.encode(texts)
    stop = np.cumsum(n)
    want = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    assert all(got[b - k : b].tolist() == w for b, k, w in zip(stop.tolist(), n.tolist(), want, strict=True))


def test_a_text_longer_than_pieces_and_a_small_cache(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    monkeypatch.setattr(tokenbin, "PIECE_CHARS", 37)
    monkeypatch.setattr(tokenbin, "CACHE_BYTES", 4000)
    enc = tokenbin.Encoder(open(path, encoding="utf-8").read())
    texts = [words(4000, 5), "ab" * 200, "", " \t", words(30, 6) + "\n" * 90 + "Tail."]
    for _ in range(2):
        got, n = enc.encode(texts)
        assert got.tolist() == [i for x in texts for i in Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids] and len(n) == 5


def test_words_that_the_cache_has_room_for_are_encoded_once(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    monkeypatch.setattr(tokenbin, "CACHE_BYTES", 70_000)
    enc = tokenbin.Encoder(open(path, encoding="utf-8").read())
    r, asked = random.Random(3), []
    through = enc._pieces
    monkeypatch.setattr(enc, "_pieces", lambda pieces: asked.append(len(pieces)) or through(pieces))
    one, two = (" ".join({"".join(r.choices("abcdefghij", k=10)): None for _ in range(500)}) for _ in range(2))
    for text, new in [(one, 500), (one, 0), (two, 500), (two, 0), (one, 500), (one + ". " + two, 500)]:
        asked.clear()
        assert enc.encode([text])[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert new <= sum(asked) <= new + 2  # the full stop is a piece too


def test_other_vocabularies_are_encoded_whole():
    from tokenizers import Tokenizer

    path = queries.vocabulary_path("byte_bpe_50k.json")
    enc = tokenbin.Encoder(open(path, encoding="utf-8").read())
    got, n = enc.encode(["Hello  World", "", "x"])
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(["Hello  World", "", "x"], add_special_tokens=False)]
    assert not enc.by_words and got.tolist() == sum(want, []) and n.tolist() == list(map(len, want))


@pytest.mark.parametrize("first", [300, 70000])
def test_grammar_random_access(first):
    r = np.random.default_rng(3)
    passage = r.integers(0, 200, 300)
    docs = [r.integers(0, 12, n) for n in (1, 5, 400, 3000, 1)] + [np.zeros(999, int)] + [np.append(r.integers(0, 200, 50), passage) for _ in range(20)]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs])
    body = tokenbin.pack(ids, ends, first)
    s = tokenbin.Shard(body)
    assert len(s.rules) > 10 and len(s.symbols) < len(ids) / 2 and len(body) < len(ids) * (1 if first == 300 else 2)
    assert s.lengths.max() > 100  # the copied passage is a few nonterminals
    assert all((s.document(i) == d).all() for i, d in enumerate(docs))
    flat, e = s.documents()
    assert (flat == ids).all() and (e == ends).all()
    # no pair is left that pays
    pays = 4 if first == 300 else 3
    inside = np.ones(len(s.symbols), bool)
    inside[s.starts[1:] - 1] = False
    left = Counter()
    at = -1
    for i in np.flatnonzero(inside).tolist():
        pair = (int(s.symbols[i]), int(s.symbols[i + 1]))
        if pair[0] != pair[1] or at != i - 1:  # of a run of one symbol every other pair counts
            left[pair] += 1
            at = i
    assert max(left.values()) < pays + 2


def test_pairs_that_cannot_pay_are_not_looked_at_again(monkeypatch):
    r = np.random.default_rng(3)
    ids = np.minimum(r.zipf(1.3, 20_000), 5000)
    seen, look = [], tokenbin._occurrences
    monkeypatch.setattr(tokenbin, "_occurrences", lambda seq, at, narrow: seen.append(len(at) / len(seq)) or look(seq, at, narrow))
    s = tokenbin.Shard(tokenbin.pack(ids, np.array([7_000, 20_000]), 6000))
    assert (s.document(0) == ids[:7000]).all() and (s.document(1) == ids[7000:]).all()
    assert seen[0] > 0.9 and seen[-1] < 0.5


def test_grammar_of_nothing_and_of_one_id():
    s = tokenbin.Shard(tokenbin.pack(np.array([1]), np.array([1]), 300))
    assert s.document(0).tolist() == [1] and len(s.rules) == 0


# --- 8: top-k ------------------------------------------------------------------------------------


def test_top_k_matches_brute_force(spark):
    r = np.random.default_rng(5)
    vec = {i: r.normal(size=24).astype(np.float32).tolist() for i in range(120)}
    vec[10], vec[20], vec[30] = vec[50][:], vec[0][:], [float("nan")] * 24
    vec |= {31: None, 32: [None] + [0.0] * 23, 33: [float("inf")] * 24, 34: [0.0] * 24, 35: [], 36: [1.0, 2.0], 100: [3e30] * 24}
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vec.items()] + [(None, vec[1], 0, "x")], "vec_id long, embedding array<float>, score int, rank string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    ok = {i: [min(max(int(np.floor(np.float64(256) * np.float64(np.float32(x)))), -(2**63)), 2**63 - 1) for x in v] for i, v in vec.items() if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (0, 50, 100):
        s = sorted((-max(min(sum(a * b for a, b in zip(ok[q], v, strict=True)), 2**63 - 1), -(2**63)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:5])]
    assert [tuple(g) for g in got if g.query_id < 100] and sorted(tuple(g) for g in got if g.query_id < 100) == sorted(w for w in want if w[0] < 100)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = topk.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, query_bytes=1).collect()
    assert [x.rank for x in sorted(few, key=lambda x: x.rank)] == [1, 2]


@pytest.mark.parametrize("query_bytes", [1 << 25, 100])
def test_rows_that_repeat_an_id_are_candidates_of_each_other(spark, query_bytes):
    rows = [(50, [1.0, 0.0]), (50, [2.0, 0.0]), (1, [0.5, 0.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0]), (7, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=3, query_bytes=query_bytes).collect())
    want = []
    for i, (q, v) in enumerate(rows[:5]):
        if q % 50 == 0:
            s = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, w, strict=True)), c) for j, (c, w) in enumerate(rows[:5]) if i != j)
            want += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s[:3])]
    assert got == sorted(want)


def test_bounds_of_earlier_blocks_lose_nothing(monkeypatch):
    r = np.random.default_rng(3)
    q, c = np.floor(r.normal(size=(7, 20)) * 50), np.floor(r.normal(size=(20, 900)) * 50)
    best = [[] for _ in q]
    for a in range(0, 900, 100):
        topk.block_top_k(q, c[:, a : a + 100], np.arange(a, min(a + 100, 900)), 4, best)
    scores = (q @ c).astype(int)
    assert best == [sorted((-int(s), i) for i, s in enumerate(row))[:4] for row in scores]


# --- 9: url filter -------------------------------------------------------------------------------

URLS = ["http://A.Example.org/es/x", "https://example.org/en/12?x", "http://x.com/fr/", "http://b.com/de/1#t", "example.org/es/", None, "http://", "://org/", "http://notorg/", "http://org", "http://org?q=/", "ftp://u:p@com/fr/a", "http://evilexample.org/es/1", "a://b://example.org/es/"]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, path string")
    got = {r.id: tuple(r)[1:] for r in urlfilter.judge_urls(df, queries.URL_RULES).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :]
        for c in "?#":
            path = path.split(c)[0]
        host = host.lower()
        fits = [(len(r), r, v) for v, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits) if fits else (0, None, "allow")
        assert got[i] == got[i + len(URLS)] == (host, path, best[1], best[2]), u
    assert urlfilter.judge_urls(df.where("false"), queries.URL_RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys[:400]] + [(None,), (keys[0],)], "key string")
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    c = urlfilter.build_cascade(listed, universe)
    assert len(c.levels) >= 2
    got = {r.key for r in universe.where(c.member(F.col("key"))).collect()}
    assert got == set(keys[:400])
    assert universe.where(urlfilter.build_cascade(listed.where("false"), universe).member(F.col("key"))).count() == 0


def test_cascade_of_many_keys(spark):
    universe = spark.range(400_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("substring(key, 2) % 4 = 1")
    c = urlfilter.build_cascade(listed, universe)
    assert 64 * sum(x.size for x in c.levels) < 8 * 100_000
    wrong = universe.where(c.member(F.col("key")) != (F.expr("substring(key, 2) % 4 = 1")))
    assert wrong.count() == 0


def test_hosts_of_many_labels(spark):
    host = "a." * 20000 + "example.org"
    df = spark.createDataFrame([(1, f"http://{host}/es/1"), (1, f"http://{host}/es/1"), (2, "http://" + "." * 5000 + "/x")], "page_id long, url string")
    got = sorted((r.id, r.rule, r.verdict) for r in urlfilter.judge_urls(df, queries.URL_RULES).collect())
    assert got == [(1, "example.org/es/", "block")] * 2 + [(2, None, "allow")]


# --- 10: suffix-array dedup ----------------------------------------------------------------------


def brute_removed(texts, n):
    enc = [(t or "").encode() for t in texts]
    seen = Counter(e[i : i + n] for e in enc for i in range(len(e) - n + 1))
    out = []
    for e in enc:
        gone = [False] * len(e)
        for i in range(len(e) - n + 1):
            if seen[e[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(e), sum(gone), spans, bytes(b for b, g in zip(e, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("limit", [1024, 1])
def test_repeated_strings_match_brute_force(spark, limit):
    r = random.Random(9)
    passage = words(60, 1)
    texts = [words(100, 50 + i) + (passage[r.randint(0, 40) :] if i % 2 else "") + words(40, 90 + i) for i in range(30)]
    texts += [texts[0], texts[0], None, "", "x" * 199, "x" * 200, "y" * 201, "ü" * 150, "ab" * 300, passage * 3, "z" * 199, texts[3][:350]]
    rows = list(enumerate(texts))
    got = {x.id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffixdedup.remove_repeats(documents(spark, rows), group_limit=limit).collect()}
    assert got == dict(enumerate(brute_removed(texts, 200)))


def test_repeated_rows_and_null_ids(spark):
    t = words(80, 2)
    rows = [(1, t), (1, t), (None, words(90, 3)), (None, words(90, 3)), (2, words(90, 4)), (2, "other")]
    got = Counter((x.id, x.n_removed == x.n_bytes) for x in suffixdedup.remove_repeats(documents(spark, rows)).collect())
    assert got == Counter({(1, True): 2, (None, True): 2, (2, False): 2})
    assert suffixdedup.remove_repeats(documents(spark, [])).count() == 0


def test_interval_expansion_matches_brute_force():
    r = random.Random(3)
    for trial in range(60):
        n = r.choice([3, 5, 8, 20])
        base = [bytes(r.choices(b"ab" if trial % 2 else b"abcdefgh\xff\x00", k=r.randint(0, 60))) for _ in range(3)]
        ctx = [b"".join(r.choice(base)[r.randint(0, 5) :] for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 9))]
        seen = Counter(c[i : i + n] for c in ctx for i in range(len(c) - n + 1))
        want = [v for c in ctx for v in [*(i + n <= len(c) and seen[c[i : i + n]] > 1 for i in range(len(c))), False]]
        assert suffixdedup.repeated_starts(ctx, n).tolist() == want


def test_anchors_do_not_depend_on_strides(monkeypatch):
    data = np.frombuffer(words(3000, 4).encode(), np.uint8)
    off = np.array([0, 100, 100, 5000, len(data)])
    whole = suffixdedup.anchors(data, off)
    monkeypatch.setattr(suffixdedup, "_STRIDE", 1777)
    parts = suffixdedup.anchors(data, off)
    starts = lambda x: {(int(s) + j, int(h)) for _, s, c, h, _ in zip(*x, strict=True) for j in range(int(c))}
    assert starts(whole) == starts(parts) and len(starts(whole)) == sum(max(0, b - a - 199) for a, b in zip(off, off[1:], strict=False))


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in cp.STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, tiny).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != "token_files":
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    odd = documents(spark, [(1, None), (2, ""), (3, "ok text here"), (None, "more text"), (3, "ok text here")])
    for _, stage in cp.STAGES:
        assert stage(spark, odd, tiny).count() >= 0
        assert stage(spark, odd.where("false"), tiny).count() == 0
