"""Near duplicates by Jaccard similarity against all pairs."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gradecut.llm import similar
from gradecut.llm.common import read_table
from tests.llm import odd

SF = "/root/testdata/sf0.001"


def plain_groups(texts):
    """Smallest id of each text's group, by all pairs of plain shingle sets."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(texts, 2):
        x, y = sets[i], sets[j]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in texts}


def edited(rng, words, edits):
    words = list(words)
    for place in rng.sample(range(len(words)), edits):
        words[place] = f"new{rng.randrange(10**6)}"
    return words


def family_texts():
    """Texts with copies on both sides of the bound, chains, equal sets and texts without words."""
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 120, 400)))]
        texts.append(base)
        texts += [edited(rng, base, k) for k in (1, 2, 3, 5)]
        for _ in range(3):
            texts.append(edited(rng, texts[-1], 1))
    texts = [" ".join(t) for t in texts] + ["", None, " \t ", "one two", "ONE  two", "one three"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_stage_links_at_the_bound(spark):
    texts = family_texts()
    groups = plain_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = corpus_pipeline.one_of_each(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(groups.values()))
    assert similar.keep_one(docs.limit(0)).count() == 0


def test_nodes_of_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOT", 1)
    texts = dict(list(family_texts().items())[:120])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == sorted(set(plain_groups(texts).values()))


def hot_family(rng, count):
    """Texts of thirty words that share buckets by the score, few of them similar."""
    base = [f"w{i}" for i in range(30)]
    return [" ".join(edited(rng, base, 1 + i % 2)) for i in range(count)]


def test_hot_family_in_blocks(spark, monkeypatch):
    # blocks far smaller than the buckets, and sets over SMALL, so that every way of deciding is taken
    texts = dict(enumerate(hot_family(random.Random(3), 150)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = sorted(set(plain_groups(texts).values()))
    for block, small in ((1024, 2048), (16, 2048), (16, 10)):
        monkeypatch.setattr(similar, "BLOCK", block)
        monkeypatch.setattr(similar, "SMALL", small)
        assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == want


def test_chance_to_meet():
    rng, met = random.Random(9), 0
    for _ in range(200):
        both, own = rng.sample(range(10**9), 80), rng.sample(range(10**9, 2 * 10**9), 20)
        sets = [np.array(sorted(both + own[:10]), np.uint64), np.array(sorted(both + own[10:]), np.uint64)]
        mixed = [similar.bands_of(np.unique(s * np.uint64(0x9E3779B97F4A7C15))) for s in sets]
        met += bool((mixed[0] == mixed[1]).any())
    assert met >= 198  # similarity 0.8: 1 in 1,000 is missed


def test_given_documents(spark):
    docs = read_table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in similar.keep_one(docs).collect()} == set(plain_groups(texts).values())
    assert similar.keep_one(odd.documents(spark)).columns == odd.documents(spark).columns


def test_fingerprints_propose_pairs(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), "alpha beta gamma " * 60, "alpha beta gamma " * 60 + "x y z v w", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = similar.marks_of(docs)
    ids = {r["node"]: r["doc_id"] for r in marks.collect()}
    ids_of = lambda pairs: {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in pairs.collect()}
    # the second pair's fingerprints are as near, but its sets are not: whole sets decide
    assert ids_of(similar.fingerprint_pairs(marks)) == {(0, 1), (2, 3)}
    without_bands = marks.withColumn("buckets", F.array().cast("array<bigint>"))
    assert ids_of(similar.similar_links(without_bands, docs, 5, 0.8)) == {(0, 1)}
