"""School record against exam mark: one pass to a sufficient table, then small arithmetic.

Marks are whole hundredths, so a cohort of any size folds to at most 901 rows of sums.
Bins, merged knots, spreads and the residual correlation all come from that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradecut.functions.marks import is_eligible, snap_to_grid_h
from gradecut.params import (
    KNOTS_2025,
    MARK_MAX,
    MARK_MIN,
    MAX_MARKS,
    CalibrationParams,
    EffectParams,
)
from gradecut.session import checked_broadcast, cut_lineage

KNOT_FIELDS = ("romana", "romana_sd", "matematica", "matematica_sd")
_SUMS = ("n", "sum_r", "sum_rr", "sum_m", "sum_mm", "sum_rm")
_WIDE = "decimal(38,0)"


def eligible_results(results: DataFrame) -> DataFrame:
    """Complete results without a third paper."""
    return results.filter(
        is_eligible(
            F.col("romana_h"),
            F.col("matematica_h"),
            F.col("media_h"),
            F.col("school_media_h"),
            F.col("materna_h"),
        )
    )


def mark_sums(results: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts, sums and products of both marks per school record: exact and mergeable."""
    r, m = F.col("romana_h"), F.col("matematica_h")
    return (
        eligible_results(results)
        .groupBy(*group, F.col("school_media_h").alias("x_h"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(r).alias("sum_r"),
            F.sum(r * r).alias("sum_rr"),
            F.sum(m).alias("sum_m"),
            F.sum(m * m).alias("sum_mm"),
            F.sum(r * m).alias("sum_rm"),
        )
    )


def _merged(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS])


def with_moments(df: DataFrame) -> DataFrame:
    """Means and population spreads in mark units from exact integer sums."""

    def spread(total: str, squares: str) -> Column:
        n, s, ss = (F.col(c).cast(_WIDE) for c in ("n", total, squares))
        return F.sqrt((n * ss - s * s).cast("double")) / F.col("n") / 100

    return df.withColumns(
        {
            "romana": F.col("sum_r") / F.col("n") / 100,
            "romana_sd": spread("sum_r", "sum_rr"),
            "matematica": F.col("sum_m") / F.col("n") / 100,
            "matematica_sd": spread("sum_m", "sum_mm"),
        }
    )


def calibrate_bins(
    sums: DataFrame, group: Sequence[str] = (), params: CalibrationParams = CalibrationParams()
) -> DataFrame:
    """Sums per grid bin of the school record."""
    binned = sums.withColumn("bin_h", snap_to_grid_h(F.col("x_h"), params.step_h))
    return _merged(binned, [*group, "bin_h"])


def merge_thin_bins(
    bins: DataFrame, group: Sequence[str] = (), params: CalibrationParams = CalibrationParams()
) -> DataFrame:
    """Add ``knot_h`` to each bin: thin bins fold upward into the first bin that holds
    ``min_count`` with them; a thin tail joins the last knot. No knot if none ever does."""
    # One entry per bin of the scale: 37 at the default step.
    entry = F.struct("bin_h", "n")
    start = F.struct(
        F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("knots")
    )

    def fold(acc: Column, b: Column) -> Column:
        total = acc["carry"] + b["n"]
        full = total >= params.min_count
        return F.struct(
            F.when(full, F.lit(0).cast("bigint")).otherwise(total).alias("carry"),
            F.when(full, F.array_append(acc["knots"], b["bin_h"])).otherwise(acc["knots"]).alias("knots"),
        )

    listed = bins.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("_bins"))
    folded = listed.withColumn("_knots", F.aggregate("_bins", start, fold)["knots"])
    placed = folded.select(*group, "_knots", F.explode("_bins").alias("_b")).select(
        *group,
        "_knots",
        F.col("_b.bin_h").alias("bin_h"),
        F.filter("_knots", lambda k: k >= F.col("_b.bin_h")).alias("_above"),
    )
    knot = F.coalesce(F.try_element_at("_above", F.lit(1)), F.try_element_at("_knots", F.lit(-1)))
    mapping = placed.select(*group, "bin_h", knot.alias("knot_h"))
    return bins.join(mapping, [*group, "bin_h"])


def calibrate_knots(
    sums: DataFrame, group: Sequence[str] = (), params: CalibrationParams = CalibrationParams()
) -> DataFrame:
    """Knot table: school record, count, mean and population spread of both marks."""
    bins = merge_thin_bins(calibrate_bins(sums, group, params), group, params)
    knots = with_moments(_merged(bins.filter("knot_h is not null"), [*group, "knot_h"]))
    return knots.select(
        *group, (F.col("knot_h") / 100).alias("school_media"), "n", *KNOT_FIELDS
    )


def knots_2025(spark: SparkSession) -> DataFrame:
    """The measured 2025 table as a DataFrame."""
    schema = "school_media double, romana double, romana_sd double, matematica double, matematica_sd double"
    return spark.createDataFrame(list(KNOTS_2025), schema)


def knot_cells(knots: DataFrame, group: Sequence[str] = (), step: float = 0.25) -> DataFrame:
    """Knots spread over the cells of the scale, so that interpolation is an equi-join.

    A cell names the two ends of its segment; cells outside the knots are flat. Knots must
    lie on the grid, which ``calibrate_knots`` guarantees.
    """
    group = list(group)
    first_cell, last_cell = int(MARK_MIN / step), int(MARK_MAX / step)
    # One short array per group: at most one knot per grid point.
    knot = F.struct("school_media", *KNOT_FIELDS)
    listed = knots.groupBy(*group).agg(F.array_sort(F.collect_list(knot)).alias("_k"))
    cells = listed.select(
        *group, "_k", F.explode(F.sequence(F.lit(first_cell), F.lit(last_cell))).alias("cell")
    )
    left = F.col("cell") * step
    below = F.filter("_k", lambda k: k["school_media"] <= left)
    above = F.filter("_k", lambda k: k["school_media"] > left)
    cells = cells.withColumns({"_below": below, "_above": above})
    lo = F.coalesce(F.try_element_at("_below", F.lit(-1)), F.try_element_at("_k", F.lit(1)))
    hi = F.coalesce(F.try_element_at("_above", F.lit(1)), F.try_element_at("_k", F.lit(-1)))
    # Below the first knot both ends are the first knot; at or above the last, the last.
    hi = F.when(F.size("_below") == 0, F.try_element_at("_k", F.lit(1))).otherwise(hi)
    cells = cells.withColumns({"_lo": lo, "_hi": hi})
    return cells.select(
        *group,
        "cell",
        F.col("_lo.school_media").alias("lo_x"),
        F.col("_hi.school_media").alias("hi_x"),
        *[F.col(f"_lo.{f}").alias(f"lo_{f}") for f in KNOT_FIELDS],
        *[F.col(f"_hi.{f}").alias(f"hi_{f}") for f in KNOT_FIELDS],
    )


def cell_of(x: Column, step: float = 0.25) -> Column:
    first_cell, last_cell = int(MARK_MIN / step), int(MARK_MAX / step)
    return F.least(F.lit(last_cell), F.greatest(F.lit(first_cell), F.floor(x / step).cast("int")))


def interpolated(x: Column, field: str, prefix: str = "") -> Column:
    """Value of ``field`` at ``x`` from the cell columns joined under ``prefix``."""
    lo_x, hi_x = F.col(f"{prefix}lo_x"), F.col(f"{prefix}hi_x")
    lo_y, hi_y = F.col(f"{prefix}lo_{field}"), F.col(f"{prefix}hi_{field}")
    return F.when(hi_x > lo_x, lo_y + (x - lo_x) / (hi_x - lo_x) * (hi_y - lo_y)).otherwise(lo_y)


def join_cells(
    df: DataFrame, cells: DataFrame, x: Column, prefix: str, group: Sequence[str] = ()
) -> DataFrame:
    """Attach the cell of ``x`` to every row, its columns under ``prefix``."""
    group = list(group)
    renamed = cells.select(
        *group, *[F.col(c).alias(f"{prefix}{c}") for c in cells.columns if c not in group]
    )
    keyed = df.withColumn(f"{prefix}cell", cell_of(x))
    return keyed.join(renamed, [*group, f"{prefix}cell"], "left").drop(f"{prefix}cell")


def expected_marks(sums_or_results: DataFrame, knots: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Interpolated means at ``x_h``, added as ``fit_r_h`` and ``fit_m_h`` in hundredths."""
    cells = checked_broadcast(knot_cells(knots, group), MAX_MARKS)
    x = F.col("x_h") / 100
    joined = join_cells(sums_or_results, cells, x, "_c_", group)
    fitted = joined.withColumns(
        {
            "fit_r_h": interpolated(x, "romana", "_c_") * 100,
            "fit_m_h": interpolated(x, "matematica", "_c_") * 100,
        }
    )
    return fitted.drop(*[c for c in fitted.columns if c.startswith("_c_")])


def residual_rho(sums: DataFrame, knots: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Correlation of both subjects' residuals about the knot table, from the sums alone."""
    fitted = expected_marks(sums, knots, group)
    f, g, n = F.col("fit_r_h"), F.col("fit_m_h"), F.col("n")
    r, m = F.col("sum_r"), F.col("sum_m")
    parts = fitted.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.sum(r - n * f).alias("_r"),
        F.sum(m - n * g).alias("_m"),
        F.sum(F.col("sum_rr") - 2 * f * r + n * f * f).alias("_rr"),
        F.sum(F.col("sum_mm") - 2 * g * m + n * g * g).alias("_mm"),
        F.sum(F.col("sum_rm") - g * r - f * m + n * f * g).alias("_rm"),
    )
    n = F.col("n")
    cov = F.col("_rm") / n - F.col("_r") / n * (F.col("_m") / n)
    var_r = F.col("_rr") / n - F.pow(F.col("_r") / n, 2)
    var_m = F.col("_mm") / n - F.pow(F.col("_m") / n, 2)
    return parts.select(*group, "n", (cov / F.sqrt(var_r * var_m)).alias("subject_rho"))


def calibrate(
    results: DataFrame, group: Sequence[str] = (), params: CalibrationParams = CalibrationParams()
) -> tuple[DataFrame, DataFrame]:
    """Knot table and residual correlation; the results are read once."""
    sums = cut_lineage(mark_sums(results, group))
    if sums.isEmpty():
        raise ValueError("nobody has both marks that a calibration needs")
    knots = cut_lineage(calibrate_knots(sums, group, params))
    if knots.isEmpty():
        raise ValueError(f"no bin holds {params.min_count} candidates, the calibration has no knots")
    return knots, residual_rho(sums, knots, group)


def group_effects(
    results: DataFrame,
    knots: DataFrame,
    school: str = "school_id",
    directory: DataFrame | None = None,
    params: EffectParams = EffectParams(),
) -> DataFrame:
    """Shrunken offset of every school from the table; small cohorts get zero.

    With a ``directory`` the result has exactly its schools, unobserved ones with n = 0.
    """
    rows = eligible_results(results).withColumn("x_h", F.col("school_media_h"))
    # Folded per school and record first: a hot school is at most 901 rows per task.
    folded = rows.groupBy(school, "x_h").agg(
        F.count(F.lit(1)).alias("n"), F.sum("romana_h").alias("r"), F.sum("matematica_h").alias("m")
    )
    fitted = expected_marks(folded, knots)
    n = F.col("n")
    effects = fitted.groupBy(school).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("r") - n * F.col("fit_r_h")) / 100).alias("_r"),
        (F.sum(F.col("m") - n * F.col("fit_m_h")) / 100).alias("_m"),
    )
    if directory is not None:
        effects = directory.join(effects, school, "left")
    n = F.coalesce("n", F.lit(0))

    def shrunk(total: str) -> Column:
        return F.when(n < params.min_n, 0.0).otherwise(F.col(total) / (n + params.pseudo_count))

    keep = [school] if directory is None else directory.columns
    return effects.select(
        *keep, n.alias("n"), shrunk("_r").alias("romana"), shrunk("_m").alias("matematica")
    )


def format_knots(knots: DataFrame) -> DataFrame:
    """Knots as text lines: two decimals for the record, three for the rest."""
    line = F.format_string(
        "%.2f %.3f %.3f %.3f %.3f n=%d",
        "school_media",
        *KNOT_FIELDS,
        "n",
    )
    return knots.withColumn("line", line)
