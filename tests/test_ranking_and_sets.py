import math
import random

import pytest
from pyspark.sql import functions as F

from gradecut.operators import ranking, sets


def skewed(spark, n=4000):
    """A third of the rows in one stratum, and many copies of one row."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"s{i % 7}", rng.choice([5, rng.randint(0, 900)]), rng.randint(0, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "g string, a int, b int"), rows


def test_ranks_of_a_hot_stratum(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("g"), "id"
    )
    ranked = ranking.rank_within(df, ["g"], [F.col("id").desc()]).collect()
    groups = {}
    for r in sorted(ranked, key=lambda r: -r["id"]):
        groups.setdefault(r["g"], []).append(r)
    for rows in groups.values():
        assert [r["rank"] for r in rows] == list(range(len(rows)))
        assert {r["stratum_size"] for r in rows} == {len(rows)}


@pytest.mark.parametrize("count", [1, 7, 100, 333, 2000])
def test_even_sample_equals_the_plain_rule(spark, count):
    df, rows = skewed(spark)
    got = sorted(map(tuple, ranking.even_sample(df, ["g"], ["a"], count).collect()))
    want = []
    for g in {r[0] for r in rows}:
        items = sorted(r for r in rows if r[0] == g)
        if len(items) > count:
            step = len(items) / count
            items = [items[math.floor(i * step)] for i in range(count)]
        want += items
    assert got == sorted(want)


def brute_pick(pages, count):
    pages = sorted(pages, key=lambda p: (-p[1], p[0]))
    if len(pages) <= count:
        return pages
    n, chosen = len(pages), []
    full = [i for i, p in enumerate(pages) if p[1] >= 512]
    order = [0, full[-1] if full else n - 1, n // 2]
    order += [min(n - 1, math.floor(k * n / (count + 1) + 0.5)) for k in range(1, count + 1)]
    for i in order + list(range(n)):
        if i not in chosen and len(chosen) < count:
            chosen.append(i)
    return [pages[i] for i in sorted(chosen)]


def test_golden_pick(spark):
    pages = [(f"u{b}", b, 2024, "SB") for b in (100, 700, 2000, 9000, 40000, 120000)]
    df = spark.createDataFrame(pages, "url string, bytes long, year int, county string")
    got = ranking.pick_representative(df, ["year", "county"], 3).orderBy("pick_rank").collect()
    assert [r["bytes"] for r in got] == [120000, 2000, 700]


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 5, 9])
def test_picks_equal_brute_force(spark, count):
    rng = random.Random(count)
    pages = [(f"u{i}", rng.randint(1, 2000), 2024, "hot" if i % 3 else f"c{i % 11}") for i in range(300)]
    df = spark.createDataFrame(pages, "url string, bytes long, year int, county string")
    got = sorted((r["county"], r["url"]) for r in ranking.pick_representative(df, ["year", "county"], count).collect())
    want = [
        (c, p[0])
        for c in {p[3] for p in pages}
        for p in brute_pick([p for p in pages if p[3] == c], count)
        if count > 0
    ]
    assert got == sorted(want)


def test_last_write_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "q"), ("a", 2, "y")], "k string, seq int, v string")
    assert sorted(map(tuple, ranking.last_write_wins(df, ["k"], "seq").collect())) == [("a", 3, "z"), ("b", 2, "q")]


def test_snapshots_are_compared_as_multisets(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert sets.snapshot_difference(a, a).isEmpty()
    got = sorted(tuple(r) for r in sets.snapshot_difference(a, b).collect())
    assert got == [(1, None, "published", 1), (3, "y", "source", 1)]


def test_missing_groups_and_union(spark):
    have = spark.createDataFrame([("SB",), ("SB",)], "county string")
    want = spark.createDataFrame([("SB",), ("BV",)], "county string")
    assert [r["county"] for r in sets.missing_groups(want, have, ["county"]).collect()] == ["BV"]
    both = sets.union_history([have, want.withColumn("x", F.lit(1))])
    assert both.count() == 4 and both.filter("x is null").count() == 2
