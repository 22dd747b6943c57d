"""Matching the same course across years, never by its reassigned code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradecut.functions import keys
from gradecut.operators.columns import OfferCols
from gradecut.params import EPOCH_YEAR


def unique_courses(offers: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """Rows whose identity occurs once in its group and year; ambiguous ones vanish entirely.

    Copies of a hot identity collapse in the map-side aggregate, so none of them is
    shuffled more than once per task.
    """
    row = F.struct(*[F.col(c) for c in offers.columns])
    kept = offers.groupBy(*cols.group, cols.year, *cols.identity_parts()).agg(
        F.count(F.lit(1)).alias("_copies"), F.any_value(row).alias("_row")
    )
    return kept.filter("_copies = 1").select("_row.*", *cols.identity_names)


def course_panel(offers: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """One row per group, identity and year: number of copies and the usable mark.

    ``mark_h`` is null where the course is ambiguous that year or its mark did not bind.
    Only numbers are aggregated, so this stays a hash aggregate.
    """
    panel = offers.groupBy(*cols.group, *cols.identity_parts(), F.col(cols.year).alias("year")).agg(
        F.count(F.lit(1)).alias("copies"), F.max(cols.usable_mark()).alias("mark_h")
    )
    return panel.withColumn("mark_h", F.when(F.col("copies") == 1, F.col("mark_h")))


def yearly_deltas(offers: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """The panel with ``delta_h``, the change since the year before; null where unpaired.

    After the panel each identity has one row per year, so the window partitions are as
    short as the history is long.
    """
    panel = course_panel(offers, cols)
    history = Window.partitionBy(*cols.group, *cols.identity_names).orderBy("year")
    adjacent = F.lag("year").over(history) == F.col("year") - 1
    change = F.col("mark_h") - F.lag("mark_h").over(history)
    return panel.withColumn("delta_h", F.when(adjacent, change))


def course_history(
    saved: DataFrame,
    offers: DataFrame,
    cols: OfferCols = OfferCols(),
    saved_id: str = "saved_id",
    epoch_year: int = EPOCH_YEAR,
) -> DataFrame:
    """Every comparable year of each saved course: its own year by exact code, the other
    years by unambiguous identity. Adds ``history_rank``, 0 for the newest year.

    ``saved`` carries ``saved_id`` and the offer columns of the course that was saved.
    """
    facts = [c for c in offers.columns if c not in cols.group]
    wanted = saved.select(
        saved_id,
        *cols.group,
        *cols.identity_parts(),
        F.col(cols.year).alias("_saved_year"),
        *[F.col(c).alias(f"_saved_{c}") for c in cols.key],
    )
    others = unique_courses(offers, cols)
    comparable = keys.comparable_years(F.col(cols.year), F.col("_saved_year"), epoch_year)
    by_identity = (
        wanted.join(others, [*cols.group, *cols.identity_names])
        .filter(comparable & (F.col(cols.year) != F.col("_saved_year")))
        .select(saved_id, *cols.group, *facts)
    )
    own_key = [F.col(f"_saved_{c}").alias(c) for c in cols.key]
    own = wanted.select(saved_id, *cols.group, F.col("_saved_year").alias(cols.year), *own_key)
    by_code = own.join(offers, [*cols.group, cols.year, *cols.key]).select(saved_id, *cols.group, *facts)
    newest_first = Window.partitionBy(saved_id).orderBy(F.col(cols.year).desc())
    return by_code.unionByName(by_identity).withColumn(
        "history_rank", F.row_number().over(newest_first) - 1
    )


def citable_sources(sources: Column) -> Column:
    """Only web addresses of a sources array."""
    return F.filter(sources, lambda url: url.rlike("(?i)^https?://"))


def historical_facts(history: DataFrame, datasets: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """History with each year's provenance, citable sources and publication date.

    ``datasets`` has one row per group and year: provenance, sources, generated_at.
    """
    facts = datasets.select(
        *cols.group,
        cols.year,
        "provenance",
        citable_sources(F.col("sources")).alias("sources"),
        F.substring("generated_at", 1, 10).alias("published_on"),
    )
    return history.join(facts, [*cols.group, cols.year], "left")
