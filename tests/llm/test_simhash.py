"""Fingerprints, the trie join and components against brute force."""

import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gradecut.llm import simhash
from gradecut.llm.common import read_table
from tests.llm import odd

SMALL = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, budget=3):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= budget
    left, right = np.nonzero(np.triu(near, 1))
    return simhash._roots(np.arange(len(values)), left, right)


def brute_documents(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    labels = brute_components(np.array(prints, np.uint64))
    least = {}
    for label, (doc, _) in zip(labels, rows, strict=True):
        if doc is not None:
            least[label] = min(doc, least.get(label, doc))
    return sorted(((d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, labels, strict=True)), key=str)


@pytest.mark.parametrize("n,spread", [(1, 8), (2, 8), (300, 8), (3000, 20), (3000, 12)])
def test_trie_equals_brute_force(n, spread):
    rng = np.random.default_rng(n + spread)
    base = rng.integers(0, 2**63, max(1, n // 10), np.uint64)
    values = base[rng.integers(0, len(base), n)]
    for _ in range(4):
        values = values ^ (np.uint64(1) << rng.integers(0, spread, n).astype(np.uint64))
    values = np.unique(values)
    want = brute_components(values)
    assert (simhash.trie_components(values) == want).all()
    # the same through units of node pairs
    bins = (values >> np.uint64(48)).astype(int)
    nodes = simhash.top_nodes(np.bincount(bins, minlength=1 << 16), max(1, n // 17))
    pairs = simhash.node_pairs(nodes)
    near = set()
    for i, j in itertools.combinations_with_replacement(range(len(nodes)), 2):
        shared = min(nodes[i][2], nodes[j][2])
        differ = (nodes[i][0] ^ nodes[j][0]) >> (16 - shared) if shared else 0
        if differ.bit_count() <= 3:
            near.add((i, j))
    assert set(pairs) == near and len(pairs) == len(near)


def test_dense_group_is_one_component():
    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 2**18, 60_000, np.uint64))
    assert (simhash.trie_components(values) == 0).all()


def test_components_of_links(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))]
    got = {r["node"]: r["root"] for r in simhash.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = simhash._roots(np.arange(300), np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
    assert all(parent[n] == r for n, r in got.items())
    assert all(parent[n] == n for n in range(300) if n not in got)
    assert simhash.connected(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0


def test_edges(spark):
    docs = odd.documents(spark)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_documents(odd.ROWS)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({c for _, _, c in got}, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_where_ids_repeat(spark):
    docs = odd.documents(spark, [(1, "a b c d"), (1, "a b c d"), (1, "totally other words here"), (None, "x y z w"), (None, "x y z w")])
    assert sorted((str(r["doc_id"]), r["text"]) for r in simhash.keep_one(docs).collect()) == [
        ("1", "a b c d"),
        ("1", "totally other words here"),
        ("None", "x y z w"),
    ]


def test_all_documents(spark):
    docs = read_table(spark, SMALL, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == brute_documents(rows)
    kept = simhash.keep_one(docs).select(F.collect_set("doc_id")).first()[0]
    assert set(kept) == {c for _, _, c in brute_documents(rows)}
