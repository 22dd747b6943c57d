"""Ranked search, whitening and quality rules: brute force and edge cases."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from gradecut.llm import lexical, quality, whitening
from gradecut.llm.common import read_table
from tests.llm import odd

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL_LETTERS = str.maketrans({chr(b): chr(b + 32) for b in range(65, 91)})

# ---- ranked search


def plain_terms(text):
    return TERM.findall((text or "").translate(SMALL_LETTERS))


def plain_search(documents, items, k=10):
    texts = [(i, Counter(plain_terms(t))) for i, t in documents]
    count = sum(bool(c) for _, c in texts)
    total = sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in texts:
            score = 0
            for term, repeats in Counter(plain_terms(text)).items():
                if tf := c.get(term):
                    m = 25 + 75 * sum(c.values()) * count // total
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[term] + 1)))
                    score += repeats * w * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string, score string")


def test_terms():
    for text in ("", "A b_C\x00d É9 ñ x y 中文!Z", "ABC İ Σς", "\t\n x"):
        assert [t.decode() for t in lexical.terms_of(text.encode())] == plain_terms(text)


def test_search_on_odd_documents(spark):
    docs = odd.documents(spark)
    items = [(1, "the CAT and the cat", "x"), (1, "the CAT and the cat", "x"), (2, None, None), (3, "", ""), (4, "license tail é", ""), (None, "one two", "")]
    got = sorted(map(tuple, lexical.search(docs, benchmark(spark, items)).collect()), key=str)
    assert got == plain_search(odd.ROWS, [i[:2] for i in items]) and got
    assert lexical.search(docs.limit(0), benchmark(spark, items)).count() == 0
    assert lexical.search(docs, benchmark(spark, [])).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(docs, benchmark(spark, [(1, None, None)])).count() == 0


def test_search_in_small_shards_and_blocks(spark, monkeypatch):
    documents = read_table(spark, SF, "documents")
    given = read_table(spark, SF, "benchmark")
    monkeypatch.setattr(lexical, "BLOCK", 300)
    blocks = list(lexical.blocks_of(given, 300))
    assert len(blocks) > 5 and sum(map(len, blocks)) == given.count()
    got = sorted(map(tuple, lexical.search(documents, given).collect()), key=str)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert got == plain_search(rows, [tuple(r) for r in given.select("item_id", "text").collect()])


def random_shard(rng, docs, terms, first=0):
    sizes = rng.integers(1, 12, docs)
    each = [np.sort(rng.choice(terms, min(n, terms), replace=False, p=_skew(terms))) for n in sizes]
    ends = np.cumsum([0, *map(len, each)])
    counts = rng.integers(1, 9, ends[-1])
    return lexical.Shard(np.arange(docs) + first, rng.integers(25, 200, docs), ends, np.concatenate(each), counts)


def _skew(n):
    p = 1 / np.arange(1, n + 1)
    return p / p.sum()


def test_shards_equal_full_scores_and_stop_early():
    rng = np.random.default_rng(3)
    full = read = 0
    for _ in range(30):
        best, everything = lexical.Best(5), []
        terms = rng.choice(12, 4, replace=False)
        weights = rng.integers(1, 5000, 4)
        for part in range(3):
            shard = random_shard(rng, 400, 12, 400 * part)
            lists = shard.lists(terms, weights)
            scores = np.zeros(400, np.int64)
            for w, docs, values, places, top_docs, top_values in lists:
                scores[docs] += w * values
                assert (top_docs[places] == docs).all() and (np.diff(top_values) <= 0).all()
            everything += [(-s, i + 400 * part) for i, s in enumerate(scores.tolist()) if s > 0]
            read += lexical.search_shard(shard, lists, best)[0]
            full += sum(len(one[1]) for one in lists)
        assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist(), strict=True)] == sorted(everything)[:5]
    assert read < 0.8 * full


def test_equal_scores_do_not_stop():
    # all documents alike: the bound equals the k-th score until the end, so the smallest ids are found
    n = 200
    shard = lexical.Shard(np.arange(n)[::-1].copy(), np.full(n, 100), np.arange(n + 1), np.zeros(n, np.int64), np.ones(n, np.int64))
    best = lexical.Best(10)
    lexical.search_shard(shard, shard.lists(np.array([0]), np.array([7])), best)
    assert best.ids.tolist() == list(range(10))


# ---- whitening


def plain_whitening(rows, components=16):
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in sound], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    z = (fit * n - sums).astype(np.longdouble) / n
    v = (z.T @ z / n).astype(np.float64)
    e, p = np.linalg.eigh(v)
    e, p = e[::-1][:components], p[:, ::-1][:, :components]
    white = (((x * n - sums).astype(np.longdouble) / n) @ p) / np.sqrt(e)
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums.tolist(), strict=True)) for r in x.tolist()]
    return [i for i, _ in sound], n, deviation, white, e / np.trace(v)


def vectors(spark, rows):
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("x", T.StringType())])
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], kind)


def test_whitening_equals_plain(spark):
    given = read_table(spark, SF, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in given.select("vec_id", "embedding").collect()]
    ids, n, deviation, white, share = plain_whitening(rows)
    got = whitening.whiten(given).collect()
    assert len(got) == 16 * len(ids)
    where = {d: i for i, d in enumerate(ids)}
    table = np.zeros((len(ids), 16))
    for r in got:
        table[where[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[where[r["vec_id"]]]
        assert abs(r["explained"] - share[r["component"] - 1]) < 1e-9 and r["identity_error"] < 1e-9
    signs = np.sign((table * white).sum(axis=0).astype(float))
    assert np.abs(table - white * signs).max() < 1e-7


def test_whitening_of_odd_vectors(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0])]
    rows += [(6, [None, 1.0]), (None, [2.0, -1.0]), (7, [3.0]), (8, [-0.01, 0.3])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, 2: 4, None: 2, 7: 2, 8: 2}
    assert {r["n"] for r in got} == {4} and max(r["identity_error"] for r in got) < 1e-12
    kept = {(r["vec_id"], r["component"]): r for r in got}
    plain = [(i, v if v is None or len(v) == 2 else [*v, 0.0]) for i, v in rows if i != 6]
    ids, _, deviation, white, _ = plain_whitening(plain)
    for i, d, w in zip(ids, deviation, white, strict=True):
        assert kept[i, 1]["deviation"] == d and abs(abs(kept[i, 1]["whitened"]) - abs(w[0])) < 1e-9
    for few in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(vectors(spark, few)).count() == 0
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0, 5.0])])).collect()
    assert {r["component"] for r in flat} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in flat)


@pytest.mark.parametrize("spectrum", ["spread", "clusters", "tight", "equal", "steep", "rank"])
def test_refined_eigenvectors(spectrum):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((24, 24)))
    values = {
        "spread": np.arange(1.0, 25),
        "clusters": np.repeat([1.0, 2.0, 5.0], 8) + 1e-4 * rng.random(24),
        "tight": np.repeat([1.0, 2.0, 5.0], 8) + 1e-9 * np.arange(24),
        "equal": np.ones(24),
        "steep": 10.0 ** -np.arange(24),
        "rank": np.append(np.arange(1.0, 11), np.zeros(14)),
    }[spectrum]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.eigen(a)
    assert (np.diff(e) <= 1e-15).all() and np.abs(v.T @ v - np.eye(24)).max() < 1e-14
    assert np.abs(a @ v - v * e).max() < 2e-15 * np.abs(a).max() * 24
    assert np.abs(np.sort(e) - np.sort(values)).max() < 1e-14 * max(values)
    single = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(single.T @ single - np.eye(24)).max() > 1e-9  # what the refinement starts from


def test_clustered_directions_are_double_precise():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    values = np.array([3 + 1e-5, 3 + 2e-5, 3 + 3e-5, *range(4, 13)], float)
    a = (q.astype(np.longdouble) * values) @ q.T.astype(np.longdouble)
    e, v = whitening.eigen(((a + a.T) / 2).astype(np.float64))
    turned = np.abs(v[:, ::-1].T @ q)
    assert np.abs(turned - np.eye(12)).max() < 1e-9


def test_deviation_too_large():
    model = whitening.Fit(2**40, (0, 0), np.zeros(0), np.zeros((2, 0)), 0.0)
    assert model.deviations(np.zeros((0, 2), np.int64)).tolist() == []
    with pytest.raises(OverflowError):
        model.deviations(np.array([[2**30, 1]]))


# ---- quality rules


def plain_quality(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    repeated = len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)})
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    stops = {w for each in quality.STOP_WORDS.values() for w in each.split()}
    n, n_stops = len(words), sum(w in stops for w in re.findall(r"[^\W\d_]+", text.lower()))
    chars, dup = sum(map(len, words)), len(lines) - len(set(lines))
    failed = n < 50 or 100 * repeated > 50 * n
    good = 250 * n <= 100 * chars <= 1200 * n and 100 * symbols <= 20 * n and 100 * n_stops >= 6 * n and 100 * dup <= 50 * len(lines)
    return n, chars, symbols, dup, repeated, failed, not failed and good


ODD = [
    (20, "a a a a"), (21, "x y z x y z"), (22, "x y z x y"), (23, "one two"), (24, "same line\nsame line\n\n \nsame line "),
    (25, "   é中文😀 # * $ % & | < >"), (26, "The of AND to. a-in FÜR für " * 20), (27, "word " * 40_000), (28, " lead\n\ntrail "),
    (29, " ".join(f"w{i} the" for i in range(60)) + "\n" + " ".join(f"v{i} of" for i in range(60))), (30, "\x0b\x0c\r\t"),
]


def test_quality_counts(spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    docs = odd.documents(spark, odd.ROWS + ODD)
    got = sorted((tuple(r) for r in quality.judge(docs).select("doc_id", *names).collect()), key=str)
    assert got == sorted(((i, *plain_quality(t)) for i, t in odd.ROWS + ODD), key=str)
    assert any(r[-1] for r in got)
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_on_documents(spark):
    documents = read_table(spark, SF, "documents")
    texts = dict(documents.select("doc_id", "text").collect())
    rows = quality.judge(documents).collect()
    for r in rows:
        want = plain_quality(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == want
        assert r["kept"] == (not r["base_failed"] and not r["broken"])
    assert quality.keep(documents).count() == sum(r["kept"] for r in rows)


def test_quality_follows_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality.judge(read_table(spark, folder, "documents")).join(read_table(spark, folder, "labels"), "doc_id")
    rows = judged.filter("NOT base_failed").select("kept", "quality").collect()
    assert len(rows) > 200 and all(r["kept"] == (r["quality"] == 1) for r in rows)


def test_own_rules(spark):
    docs = odd.documents(spark, [(1, "alpha beta gamma delta epsilon " + " ".join(f"w{i}" for i in range(60)))])
    strict = (quality.Rule("length", "word_chars", "n_words", high=200),)
    row = quality.judge(docs, strict).first()
    assert row["broken"] == ["length"] and not row["kept"] and not row["base_failed"]
    assert quality.judge(docs, ()).first()["kept"]


def test_quality_has_no_python(spark):
    plan = quality.judge(read_table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
