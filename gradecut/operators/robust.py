"""Exact robust statistics on bounded histograms and short arrays, and by selection on any doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradecut.params import CutoffParams
from gradecut.session import checked_broadcast, cut_lineage

GRID = 128
MOST_HELD = 10_000
MOST_CURSORS = 100_000


def weighted_median(value: str, count: str) -> Column:
    """Exact median of ``value`` occurring ``count`` times; even sizes are averaged.

    The buffer holds one entry per distinct value: on the mark grid that is at most a few
    thousand, however many rows there are.
    """
    return F.expr(f"percentile({value}, 0.5D, {count})")


def array_median(ordered: Column) -> Column:
    """Median of a short sorted array; null when empty."""
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def robust_scale(
    df: DataFrame,
    value: str,
    group: list[str],
    out: str = "robust_scale",
    factor: float = CutoffParams.mad_factor,
) -> DataFrame:
    """Per group: median and ``factor`` times the median absolute deviation.

    Rows are first folded to value counts, with the partial counts combined before the
    shuffle; groups without a value give null.
    """
    counts = df.groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    per_group = Window.partitionBy(*group)
    centred = counts.withColumn("_centre", weighted_median("_v", "_n").over(per_group)).withColumn(
        "_dev", F.abs(F.col("_v") - F.col("_centre"))
    )
    return centred.groupBy(*group).agg(
        F.first("_centre", ignorenulls=True).alias("median"),
        (weighted_median("_dev", "_n") * factor).alias(out),
    )


def _narrowed(rows: DataFrame, cursors: DataFrame, group: list[str], held: int) -> tuple[DataFrame, DataFrame]:
    """One pass of selection: cursors that are settled, and those to go on with, both written.

    A cursor (group, rank, low, high, below, n) says that the value of that rank lies in [low, high],
    which holds ``n`` values, and that ``below`` values are smaller than ``low``.
    """
    cursor = [*group, "rank", "below"]
    # one sketch for all cursors of a range: a sketch and a copy of the rows for each would be sorted on disk
    span = [*group, "low", "high"]
    near = rows.join(checked_broadcast(cursors.select(*span).distinct(), MOST_CURSORS), group)
    near = near.filter(F.col("_x").between(F.col("low"), F.col("high")))
    grid = near.groupBy(*span).agg(F.percentile_approx("_x", [i / GRID for i in range(GRID + 1)], 10 * GRID).alias("_grid"))
    place = F.floor((F.col("rank") - F.col("below")) / F.col("n") * GRID).cast("int")
    gridded = cursors.join(cut_lineage(grid), span)
    ends = cut_lineage(gridded.select(*cursor, F.get("_grid", place).alias("_l"), F.get("_grid", place + 1).alias("_u")))
    split = rows.join(checked_broadcast(cursors.join(ends, cursor), MOST_CURSORS), group)
    split = split.filter(F.col("_x").between(F.col("low"), F.col("high")))
    # under, at, between, at and over the two ends: what is at an end is settled, so every pass gets on
    x, tests = F.col("_x"), (F.col("_x") >= F.col("_l"), F.col("_x") > F.col("_l"), F.col("_x") >= F.col("_u"))
    bin_no = sum((t.cast("int") for t in tests), (x > F.col("_u")).cast("int"))
    counts = split.groupBy(*cursor, bin_no.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high")
    )
    upto = F.sum("n").over(Window.partitionBy(*cursor).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("_before", F.col("below") + F.coalesce(upto, F.lit(0)))
    inside = (F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("n"))
    hit = cut_lineage(placed.filter(inside).select(*group, "rank", F.col("_before").alias("below"), "low", "high", "n"))
    done = hit.filter(F.col("low") == F.col("high")).select(*group, "rank", F.col("low").alias("value"))
    small = hit.filter((F.col("low") < F.col("high")) & (F.col("n") <= held))
    few = rows.join(checked_broadcast(small, MOST_CURSORS), group).filter(F.col("_x").between(F.col("low"), F.col("high")))
    picked = few.groupBy(*group, "rank", "below").agg(F.array_sort(F.collect_list("_x")).alias("_all"))
    value = F.get("_all", (F.col("rank") - F.col("below")).cast("int"))
    settled = cut_lineage(done.unionByName(picked.select(*group, "rank", value.alias("value"))))
    return settled, cut_lineage(hit.filter((F.col("low") < F.col("high")) & (F.col("n") > held)))


def order_statistics(rows: DataFrame, ranks: DataFrame, group: list[str], value: str, held: int = MOST_HELD) -> DataFrame:
    """group, rank and value: the values of the given 0-based ranks (group, rank) among each group's.

    Selection by repeated counting: in each pass a sketch of ``GRID`` quantiles proposes two values
    around the rank, all values under, at, between and over them are counted exactly, and the part
    that holds the rank is gone on with, until it is one value or at most ``held``, which are then
    sorted. So no buffer is larger than that, however many different values a group has and however
    they are spread; a wrong proposal costs a pass and no exactness. Nulls and NaN are left out.
    """
    return _of_ranks(_sound(rows, group, value), ranks, group, held)


def _sound(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group and value (as ``_x``) of the rows with a number, written."""
    x = F.col(value).cast("double").alias("_x")
    return cut_lineage(rows.select(*group, x).filter(F.col("_x").isNotNull() & ~F.isnan("_x")))


def _of_ranks(kept: DataFrame, ranks: DataFrame, group: list[str], held: int) -> DataFrame:
    ends = kept.groupBy(*group).agg(F.min("_x").alias("low"), F.max("_x").alias("high"), F.count("*").alias("n"))
    left = cut_lineage(ranks.select(*group, "rank").distinct().join(ends, group).withColumn("below", F.lit(0).cast("bigint")))
    found = None
    while found is None or not left.isEmpty():
        settled, left = _narrowed(kept, left, group, held)
        found = settled if found is None else found.unionByName(settled)
    return found


def grouped_quantiles(
    rows: DataFrame, group: list[str], value: str, quantiles: dict[str, float], held: int = MOST_HELD
) -> DataFrame:
    """Exact quantiles of each group, interpolated between neighbouring values, one column for each name."""
    sound = _sound(rows, group, value)
    sizes = cut_lineage(sound.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_size") - 1) * F.lit(q)).alias("at")) for name, q in quantiles.items()])
    each = sizes.select(*group, F.explode(asked).alias("_q")).select(
        *group, "_q.name", F.floor("_q.at").alias("below"), F.ceil("_q.at").alias("above"), "_q.at"
    )
    ranks = each.select(*group, F.explode(F.array("below", "above")).alias("rank"))
    values = cut_lineage(_of_ranks(sound, ranks, group, held))
    low = values.select(*group, F.col("rank").alias("below"), F.col("value").alias("_low"))
    high = values.select(*group, F.col("rank").alias("above"), F.col("value").alias("_high"))
    both = each.join(low, [*group, "below"]).join(high, [*group, "above"])
    mixed = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("at") - F.col("below"))
    return both.groupBy(*group).pivot("name", list(quantiles)).agg(F.first(mixed))


def selected_scale(
    rows: DataFrame, group: list[str], value: str, factor: float = CutoffParams.mad_factor, held: int = MOST_HELD
) -> DataFrame:
    """``robust_scale`` of any doubles: median and ``factor`` times the median absolute deviation, by selection."""
    centres = cut_lineage(grouped_quantiles(rows, group, value, {"median": 0.5}, held))
    off = rows.join(centres, group).withColumn("_off", F.abs(F.col(value) - F.col("median")))
    spread = grouped_quantiles(off, group, "_off", {"robust_scale": 0.5}, held)
    return centres.join(spread, group).withColumn("robust_scale", F.col("robust_scale") * factor)
