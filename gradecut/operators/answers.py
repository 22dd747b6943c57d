"""Answers for whole cohorts without ever pairing candidates with courses.

A group's courses are folded to their cutoffs, which take at most 901 values. A
candidate's probability falls as the cutoff rises, so "how many courses clear" is one
lookup in a cumulative count, and "the best reachable ones" start at one known place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradecut.functions import keys
from gradecut.functions.probability import normal_cdf_value
from gradecut.operators.columns import OfferCols
from gradecut.operators.cutoff import base_courses
from gradecut.params import MARK_MAX_H, MARK_MIN_H, MAX_COUNTIES
from gradecut.session import checked_broadcast


def _z_at(chance: float) -> float:
    """The smallest z whose approximated probability reaches ``chance``, by bisection."""
    low, high = -8.0, 8.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if normal_cdf_value(middle) >= chance else (middle, high)
    return high


def _highest_cleared(media: Column, sd: Column, chance: float) -> Column:
    """Highest cutoff in hundredths that ``media`` clears with at least ``chance``.

    The closed form lands on the grid point or next to it; the comparison decides.
    """
    z = _z_at(chance)
    guess = F.floor((media - sd * z) * 100)
    reaches = lambda h: (media - h / 100) / sd >= z
    exact = F.when(reaches(guess + 1), guess + 1).when(reaches(guess), guess).otherwise(guess - 1)
    return exact.cast("bigint")


def cutoff_profile(offers: DataFrame, models: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """One row per group: cumulative course counts over the mark grid, and the other kinds.

    ``at_most[i]`` counts courses whose cutoff is at most ``99 + i`` hundredths and
    ``slots[i]`` is the highest cutoff in that range; both arrays have 901 entries.
    """
    group = list(cols.group)
    vacant = keys.has_vacancies(F.col(cols.occupied), F.col(cols.seats))
    kind = (
        F.when(F.col(cols.vocational), "aside")
        .when(vacant, "open")
        .when(F.col(cols.mark_h).isNull(), "aside")
        .otherwise("estimate")
    )
    counts = (
        base_courses(offers, models, cols)
        .withColumn("_kind", kind)
        .withColumn("_h", F.when(F.col("_kind") == "estimate", F.col(cols.mark_h)))
        .groupBy(*group, "base_year", "step_sd", "sd", "_kind", "_h")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    entry = F.when(F.col("_h").isNotNull(), F.struct("_h", "_n"))
    # Distinct cutoffs only: at most 901 entries per group.
    profile = counts.groupBy(*group, "base_year", "step_sd", "sd").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_by_mark"),
        F.sum(F.when(F.col("_kind") == "estimate", F.col("_n")).otherwise(0)).alias("answerable"),
        F.sum(F.when(F.col("_kind") == "open", F.col("_n")).otherwise(0)).alias("open"),
        F.sum(F.when(F.col("_kind") == "aside", F.col("_n")).otherwise(0)).alias("aside"),
    )
    grid = F.sequence(F.lit(MARK_MIN_H).cast("bigint"), F.lit(MARK_MAX_H).cast("bigint"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("total"),
        F.lit(None).cast("bigint").alias("slot"),
        F.array().cast("array<bigint>").alias("totals"),
        F.array().cast("array<bigint>").alias("slots"),
    )

    def step(acc: Column, h: Column) -> Column:
        here = F.try_element_at(F.col("_by_mark"), h)
        total = acc["total"] + F.coalesce(here, F.lit(0))
        slot = F.when(here.isNotNull(), h).otherwise(acc["slot"])
        return F.struct(
            total.alias("total"),
            slot.alias("slot"),
            F.array_append(acc["totals"], total).alias("totals"),
            F.array_append(acc["slots"], slot).alias("slots"),
        )

    folded = profile.withColumn("_grid", F.aggregate(grid, start, step))
    return folded.select(
        *group,
        "base_year",
        "step_sd",
        F.col("sd").alias("model_sd"),
        F.col("_grid.totals").alias("at_most"),
        F.col("_grid.slots").alias("slots"),
        "answerable",
        "open",
        "aside",
    )


def _on_grid(array: str, h: Column, below: Column) -> Column:
    index = (F.least(h, F.lit(MARK_MAX_H)) - MARK_MIN_H + 1).cast("int")
    return F.when(index >= 1, F.get(array, index - 1)).otherwise(below)


def _total_sd(media_sd: str | None) -> Column:
    return F.col("model_sd") if media_sd is None else F.hypot("model_sd", F.coalesce(media_sd, F.lit(0.0)))


def summaries(
    candidates: DataFrame,
    offers: DataFrame,
    models: DataFrame,
    cols: OfferCols = OfferCols(),
    media: str = "media",
    media_sd: str | None = None,
) -> DataFrame:
    """The counts of ``cutoff.answer_summary`` for every candidate, one lookup each.

    A null mark is scored at probability one half, so it clears everything, all of it tight.
    Candidates of a group without a model keep their row, with zero in every count.
    """
    profile = checked_broadcast(cutoff_profile(offers, models, cols), MAX_COUNTIES)
    joined = candidates.join(profile, list(cols.group), "left").withColumn("_sd", _total_sd(media_sd))
    joined = joined.na.fill(0, ["answerable", "open", "aside"])
    none = F.lit(0).cast("bigint")
    chances = {"_p30": 0.3, "_p50": 0.5, "_p70": 0.7}
    highest = {name: _highest_cleared(F.col(media), F.col("_sd"), p) for name, p in chances.items()}
    counted = joined.withColumns(highest).withColumns(
        {name: _on_grid("at_most", F.col(name), none) for name in chances}
    )
    unknown = F.col(media).isNull()
    return counted.select(
        *candidates.columns,
        "answerable",
        F.when(unknown, F.col("answerable")).otherwise(F.coalesce("_p50", none)).alias("clears"),
        F.when(unknown, F.col("answerable")).otherwise(F.coalesce(F.col("_p30") - F.col("_p70"), none)).alias("tight"),
        "open",
        "aside",
    )


def best_courses(
    candidates: DataFrame,
    offers: DataFrame,
    models: DataFrame,
    count: int,
    cols: OfferCols = OfferCols(),
    media: str = "media",
    media_sd: str | None = None,
    max_broadcast: int = 100_000,
) -> DataFrame:
    """The ``count`` hardest courses each candidate reaches, hardest first.

    Per group and cutoff only the first ``count`` courses by name can ever be listed, and
    the window drops the rest before the shuffle. Each cutoff then owns one ready list;
    a candidate takes the list of the highest cutoff cleared. A candidate who reaches none, or
    whose group has no model, keeps one row without a course. A null mark is scored at one
    half and so takes the list from the top. The ready lists are broadcast if they hold at
    most ``max_broadcast`` courses in all.
    """
    group, key = list(cols.group), list(cols.key)
    profile = cutoff_profile(offers, models, cols).select(*group, "model_sd", "slots")
    profile = checked_broadcast(profile, MAX_COUNTIES)
    mark = cols.usable_mark()
    per_cutoff = Window.partitionBy(*group, "_h").orderBy(cols.name, *key)
    kept = (
        base_courses(offers, models, cols)
        .select(*group, *cols.key_and_name, mark.alias("_h"))
        .filter("_h is not null")
        .withColumn("_place", F.row_number().over(per_cutoff))
        .filter(F.col("_place") <= count)
    )
    item = F.struct((-F.col("_h")).alias("_neg"), "_place", *key, F.col("_h").alias("cutoff_h"))
    # At most ``count`` courses per cutoff, so at most 901 * count entries per group.
    lists = kept.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("_list"))
    begins = F.filter(
        F.sequence(F.lit(1), F.size("_list")), lambda i: F.element_at("_list", i)["_place"] == 1
    )
    tops = (
        lists.select(*group, "_list", F.explode(begins).alias("_at"))
        .select(
            *group,
            F.element_at("_list", F.col("_at"))["cutoff_h"].alias("_slot"),
            F.slice("_list", F.col("_at"), count).alias("_top"),
        )
    )
    tops = checked_broadcast(tops, max(1, max_broadcast // count))
    reach = _highest_cleared(F.col(media), _total_sd(media_sd), 0.5)
    top_mark = F.when(F.col(media).isNull(), F.lit(MARK_MAX_H).cast("bigint")).otherwise(reach)
    placed = (
        candidates.join(profile, group, "left")
        .withColumn("_reach", top_mark)
        .withColumn("_slot", _on_grid("slots", F.col("_reach"), F.lit(None).cast("bigint")))
        .select(*candidates.columns, "_slot")
    )
    listed = placed.join(tops, [*group, "_slot"], "left")
    return listed.select(*candidates.columns, F.posexplode_outer("_top").alias("_i", "_c")).select(
        *candidates.columns,
        (F.col("_i") + 1).alias("position"),
        *[F.col(f"_c.{c}").alias(f"course_{c}") for c in key],
        F.col("_c.cutoff_h").alias("cutoff_h"),
    )
