"""Set operations on snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_history(parts: list[DataFrame]) -> DataFrame:
    """Years and counties as one history; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_sources(offers: DataFrame, group: list[str], source: str = "source") -> DataFrame:
    """Sorted distinct sources per dataset: one per file delivered."""
    return offers.filter(F.col(source).isNotNull()).groupBy(*group).agg(
        F.array_sort(F.collect_set(source)).alias("sources")
    )


def snapshot_difference(published: DataFrame, source: DataFrame) -> DataFrame:
    """Rows only one side has, counted as often as they are missing there.

    One aggregation over both sides: copies are folded before the shuffle, and equal
    snapshots give an empty result.
    """
    columns = source.columns
    both = published.select(*columns).withColumn("_side", F.lit(1)).unionByName(
        source.withColumn("_side", F.lit(-1))
    )
    net = both.groupBy(*columns).agg(F.sum("_side").alias("_net")).filter("_net <> 0")
    side: Column = F.when(F.col("_net") > 0, "published").otherwise("source")
    return net.select(*columns, side.alias("only_in"), F.abs("_net").alias("copies"))


def missing_groups(expected: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Expected groups without a single row."""
    return expected.select(*key).distinct().join(present.select(*key).distinct(), key, "left_anti")


def row_hash(columns: list[str], seed: int) -> Column:
    """64-bit hash of a row that tells nulls apart by their columns."""
    return F.xxhash64(F.lit(seed), *columns, *[F.col(c).isNull() for c in columns])


def digests(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """Rows and two hash sums of each group: equal for equal multisets of rows, in any order.

    The sums are exact, so partial ones are combined before the shuffle. Different multisets agree
    in both sums with a chance of about 1 in 2 ** 128.
    """
    sums = [F.sum(row_hash(columns, seed).cast("decimal(38,0)")).alias(f"digest{seed}") for seed in (1, 2)]
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), *sums)


def changed_groups(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Groups whose ``digests`` differ, or that only one side has."""
    measures = ("rows", "digest1", "digest2")
    a = left.select(*group, F.struct(*measures).alias("_a"))
    b = right.select(*group, F.struct(*measures).alias("_b"))
    return a.join(b, group, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*group)
