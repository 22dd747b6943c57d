"""Stored change histograms and models: a new year refits what it touches.

A histogram has a row for each group, year and change between the year before and it, so it is small
and additive: a year's part depends on its own offers and the year before alone. It is stored in
folders of group and year; a delivery rewrites the folders of its years and of the years after them
(dynamic overwrite), reading no other offers, and only the delivered groups are fitted again. A delivery
replaces what it has rows for: a group's year that vanishes keeps its folder until that is removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradecut.operators.columns import OfferCols
from gradecut.operators.cutoff import delta_histogram, fit_histogram
from gradecut.params import CutoffParams
from gradecut.session import cut_lineage


def _overwrite(rows: DataFrame, path: str, parts: Sequence[str]) -> None:
    """Replace exactly the folders that ``rows`` has something for."""
    written = rows.repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    written.partitionBy(*parts).parquet(path)


def update_histogram(offers: DataFrame, years: Sequence[int], path: str, groups: DataFrame, cols: OfferCols = OfferCols()) -> None:
    """Store the histogram parts of ``years`` and the years after them, for ``groups``.

    Of ``offers``, all years' of which are readable, only these years and those before them are read;
    their filters reach the scan.
    """
    touched = sorted({y + d for y in years for d in (0, 1)})
    needed = sorted({y + d for y in touched for d in (-1, 0)})
    near = offers.filter(F.col(cols.year).isin(needed)).join(F.broadcast(groups), list(cols.group), "left_semi")
    parts = delta_histogram(near, cols).filter(F.col("year").isin(touched))
    _overwrite(parts, path, [*cols.group, "year"])


def refit(
    histogram_path: str, model_path: str, target_year: int, groups: DataFrame, cols: OfferCols = OfferCols(),
    params: CutoffParams = CutoffParams(),
) -> None:
    """Fit ``groups`` again from their stored histograms and replace their models."""
    spark = groups.sparkSession
    kinds = {name: groups.schema[name].dataType for name in cols.group}
    stored = spark.read.parquet(histogram_path)
    for name, kind in kinds.items():
        stored = stored.withColumn(name, F.col(name).cast(kind))
    mine = stored.join(F.broadcast(groups), list(cols.group), "left_semi")
    _overwrite(fit_histogram(mine, target_year, cols, params), model_path, list(cols.group))


def deliver(
    offers: DataFrame, delivered: DataFrame, path: str, target_year: int, cols: OfferCols = OfferCols(), params: CutoffParams = CutoffParams()
) -> DataFrame:
    """Take in the years and groups of ``delivered``, which ``offers`` holds as well, and give all models.

    The list of delivered groups and years reaches the driver; it has a row for each dataset.
    """
    keys = cut_lineage(delivered.select(*cols.group, F.col(cols.year).alias("year")).distinct())
    groups = cut_lineage(keys.select(*cols.group).distinct())
    years = sorted(r["year"] for r in keys.select("year").distinct().collect())
    update_histogram(offers, years, f"{path}/histogram", groups, cols)
    refit(f"{path}/histogram", f"{path}/models", target_year, groups, cols, params)
    return read_models(offers, path, cols)


def read_models(offers: DataFrame, path: str, cols: OfferCols = OfferCols()) -> DataFrame:
    """All stored models, their groups typed as in ``offers``."""
    models = offers.sparkSession.read.parquet(f"{path}/models")
    for name in cols.group:
        models = models.withColumn(name, F.col(name).cast(offers.schema[name].dataType))
    return models
