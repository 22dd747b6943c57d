"""How good the forecasts are: counters, error metrics, calibration tables, audits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.functions.marks import media_status
from gradecut.functions.probability import normal_cdf
from gradecut.operators.columns import OfferCols
from gradecut.operators.cutoff import delta_histogram, fit_histogram
from gradecut.params import MARK_MAX_H, MARK_MIN_H, MAX_COUNTIES, CutoffParams
from gradecut.session import checked_broadcast, cut_lineage

# Distance of the scored mark from the forecast cutoff, in hundredths.
OFFSETS_H = (-80, -40, 0, 40, 80)


def with_media_status(results: DataFrame) -> DataFrame:
    status = media_status(
        F.col("romana_h"), F.col("matematica_h"), F.col("materna_h"), F.col("media_h")
    )
    return results.withColumn("status", status)


def media_counters(results: DataFrame) -> DataFrame:
    """Published averages recomputed: counts by outcome and by two or three papers."""
    papers = F.when(F.col("materna_h").isNull(), 2).otherwise(3)
    return (
        with_media_status(results)
        .groupBy("status", papers.alias("papers"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def assert_media(results: DataFrame, shown: int = 10) -> None:
    """Fail with the first mismatches if any published average cannot be reproduced."""
    wrong = with_media_status(results).filter("status = 'mismatch'")
    columns = ["county", "romana_h", "materna_h", "matematica_h", "media_h"]
    sample = wrong.select(*columns).limit(shown).collect()
    if sample:
        lines = "\n".join(f"  {row.asDict()}" for row in sample)
        raise ValueError(f"{wrong.count()} averages cannot be reproduced, among them:\n{lines}")


def error_metrics(
    df: DataFrame,
    predicted: Column,
    actual: Column,
    low: Column | None = None,
    high: Column | None = None,
    naive: Column | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """Bias, mean absolute and root mean square error, coverage, and the naive error."""
    error = predicted - actual
    measures = [
        F.count(error).alias("n"),
        F.avg(error).alias("bias"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
    ]
    if low is not None and high is not None:
        covered = (actual >= low) & (actual <= high)
        measures.append(F.avg(covered.cast("double")).alias("coverage"))
    if naive is not None:
        measures.append(F.avg(F.abs(naive - actual)).alias("naive_mae"))
    return df.groupBy(*group).agg(*measures)


def brier_score(
    df: DataFrame,
    probability: Column,
    outcome: Column,
    baseline: Column | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """Mean squared gap of probability and outcome, also for a hard yes/no baseline."""
    happened = outcome.cast("double")
    measures = [
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.pow(probability - happened, 2)).alias("brier"),
    ]
    if baseline is not None:
        gap = F.pow(baseline.cast("double") - happened, 2)
        measures.append(F.avg(gap).alias("baseline_brier"))
    return df.groupBy(*group).agg(*measures)


def reliability_table(
    df: DataFrame,
    probability: Column,
    outcome: Column,
    bins: int = 5,
    min_n: int = 200,
    group: Sequence[str] = (),
) -> DataFrame:
    """Predicted against observed frequency per equal probability bin; certainty (1) and
    bins under ``min_n`` are left out."""
    binned = df.filter((probability >= 0) & (probability < 1)).groupBy(
        *group, F.floor(probability * bins).cast("int").alias("bin")
    )
    return binned.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(probability).alias("predicted"),
        F.avg(outcome.cast("double")).alias("observed"),
    ).filter(F.col("n") >= min_n)


def holdout_pairs(
    offers: DataFrame,
    holdout_year: int,
    models: DataFrame,
    cols: OfferCols = OfferCols(),
) -> DataFrame:
    """Forecast and realised cutoff of every course that has both, in one aggregation.

    ``models`` must have been fitted on earlier years only. A course counts when it is
    unambiguous and its mark binds in its group's base year and in the holdout year.
    """
    small = checked_broadcast(models.select(*cols.group, "base_year", "sd"), MAX_COUNTIES)
    year = F.col(cols.year)
    rows = offers.join(small, list(cols.group)).filter(
        (year == F.col("base_year")) | (year == holdout_year)
    )
    after = year == holdout_year
    mark = cols.usable_mark()
    paired = rows.groupBy(*cols.group, *cols.identity_parts(), "base_year", "sd").agg(
        F.count_if(~after).alias("_before"),
        F.count_if(after).alias("_after"),
        F.max(F.when(~after, mark)).alias("cutoff_h"),
        F.max(F.when(after, mark)).alias("outcome_h"),
    )
    return paired.filter(
        "_before = 1 and _after = 1 and cutoff_h is not null and outcome_h is not null"
    ).drop("_before", "_after")


def _covered(z: float) -> Column:
    gap = F.col("sd") * z
    cutoff, outcome = F.col("cutoff_h") / 100, F.col("outcome_h") / 100
    return (outcome >= cutoff - gap) & (outcome <= cutoff + gap)


def forecast_audit(
    offers: DataFrame,
    holdout_year: int,
    cols: OfferCols = OfferCols(),
    params: CutoffParams = CutoffParams(),
) -> DataFrame:
    """Per group and in total: matched courses, coverage and error of the forecast made
    before ``holdout_year``; next year's spread and the shift that was observed.

    The total row has null group columns; its rates weight every course alike.
    """
    group = list(cols.group)
    histogram = cut_lineage(delta_histogram(offers, cols))
    before = fit_histogram(histogram.filter(F.col("year") < holdout_year), holdout_year, cols, params)
    known = histogram.filter(F.col("year") <= holdout_year)
    after = fit_histogram(known, holdout_year + 1, cols, params)
    pairs = holdout_pairs(offers, holdout_year, before, cols)
    gap_h = F.abs(F.col("outcome_h") - F.col("cutoff_h"))
    scored = pairs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(_covered(params.z)).alias("covered"),
        F.sum(gap_h).alias("error_h"),
    )
    shift = F.filter("observed_shifts", lambda s: s["year"] == holdout_year)
    state = after.select(
        *group,
        F.col("sd").alias("next_sd"),
        F.try_element_at(shift, F.lit(1))["shift"].alias("observed_shift"),
    )
    # One row per group from here on.
    per_group = before.select(*group).join(state, group).join(scored, group, "left")
    sums = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("matched", "covered", "error_h")}
    one_group = F.grouping(group[0]) == 0
    return (
        per_group.rollup(*group)
        .agg(
            *[value.alias(name) for name, value in sums.items()],
            F.when(one_group, F.first("next_sd")).alias("next_sd"),
            F.when(one_group, F.first("observed_shift")).alias("observed_shift"),
            F.grouping_id().alias("_level"),
        )
        .filter(F.col("_level").isin(0, 2 ** len(group) - 1))
        .select(
            *group,
            "matched",
            "covered",
            (F.col("error_h") / 100).alias("absolute_error"),
            F.when(F.col("matched") > 0, F.col("covered") / F.col("matched")).alias("coverage"),
            F.when(F.col("matched") > 0, F.col("error_h") / 100 / F.col("matched")).alias("mae"),
            "next_sd",
            "observed_shift",
        )
    )


def offset_samples(pairs: DataFrame, offsets_h: Sequence[int] = OFFSETS_H) -> DataFrame:
    """Marks at fixed distances from each forecast cutoff, with probability and outcome.

    Marks that leave the scale are dropped, not clamped.
    """
    spread = pairs.withColumn("offset_h", F.explode(F.array(*[F.lit(o) for o in offsets_h])))
    media_h = F.col("cutoff_h") + F.col("offset_h")
    return (
        spread.withColumn("media_h", media_h)
        .filter(F.col("media_h").between(MARK_MIN_H, MARK_MAX_H))
        .withColumns(
            {
                "probability": normal_cdf(F.col("offset_h") / 100 / F.col("sd")),
                "admitted": F.col("media_h") >= F.col("outcome_h"),
                "threshold": F.col("offset_h") >= 0,
            }
        )
    )


def backtest(
    offers: DataFrame,
    holdout_year: int,
    cols: OfferCols = OfferCols(),
    params: CutoffParams = CutoffParams(),
    group: Sequence[str] = (),
) -> DataFrame:
    """Hold out a year, fit on all before it, and measure: error, coverage and Brier score
    of the model and of last year's cutoff read as a hard threshold."""
    models = fit_histogram(
        delta_histogram(offers.filter(F.col(cols.year) < holdout_year), cols), holdout_year, cols, params
    )
    pairs = cut_lineage(holdout_pairs(offers, holdout_year, models, cols))
    return _measured(pairs, params, group)


def rolling_backtest(
    offers: DataFrame,
    holdout_years: Sequence[int],
    cols: OfferCols = OfferCols(),
    params: CutoffParams = CutoffParams(),
    group: Sequence[str] = (),
) -> DataFrame:
    """``backtest`` of every holdout year in one plan, with the year as ``holdout_year``.

    The changes between years are folded to their histogram once. Each holdout takes the part of it
    that lies before it, its years moved so that all holdouts share one target year, and is a group
    of its own in one fit. The offers themselves are read once for the histogram and once for the pairs.
    """
    target = max(holdout_years)
    own = replace(cols, group=("holdout_year", *cols.group))

    def held(rows: DataFrame, year: str, before: bool) -> DataFrame:
        years = F.array(*[F.lit(y) for y in holdout_years])
        later = F.filter(years, lambda y: y > F.col(year) if before else y >= F.col(year))
        return rows.withColumn("holdout_year", F.explode(later)).withColumn(year, F.col(year) - F.col("holdout_year") + target)

    models = fit_histogram(held(delta_histogram(offers, cols), "year", True), target, own, params)
    pairs = cut_lineage(holdout_pairs(held(offers, cols.year, False), target, cut_lineage(models), own))
    return _measured(pairs, params, ["holdout_year", *group])


def _measured(pairs: DataFrame, params: CutoffParams, group: Sequence[str]) -> DataFrame:
    gap = F.col("sd") * params.z
    cutoff, outcome = F.col("cutoff_h") / 100, F.col("outcome_h") / 100
    errors = error_metrics(pairs, cutoff, outcome, cutoff - gap, cutoff + gap, group=group)
    samples = offset_samples(pairs)
    scores = brier_score(
        samples, F.col("probability"), F.col("admitted"), F.col("threshold"), group=group
    )
    if group:
        return errors.join(scores, list(group), "left")
    # Two one-row tables.
    return errors.withColumn("_one", F.lit(1)).join(scores.withColumn("_one", F.lit(1)), "_one").drop("_one")


def compare_estimators(
    offers: DataFrame,
    holdout_year: int,
    cols: OfferCols = OfferCols(),
    estimators: dict[str, CutoffParams] | None = None,
    history_years: int = 2,
) -> DataFrame:
    """The same short-history holdout under several estimators, one row each."""
    estimators = estimators or {
        "fixed_prior": CutoffParams(short_history="fixed_prior"),
        "floored": CutoffParams(),
    }
    year = F.col(cols.year)
    window = offers.filter((year >= holdout_year - history_years) & (year <= holdout_year))
    histogram = cut_lineage(delta_histogram(window.filter(year < holdout_year), cols))
    fits = None
    for name, params in estimators.items():
        fit = fit_histogram(histogram, holdout_year, cols, params)
        fit = fit.select(F.lit(name).alias("estimator"), *cols.group, "base_year", "sd")
        fits = fit if fits is None else fits.unionByName(fit)
    # The estimators share base years, so the pairs are formed once and spreads joined on.
    fits = checked_broadcast(fits, MAX_COUNTIES * len(estimators))
    first = next(iter(estimators))
    models = fits.filter(F.col("estimator") == first)
    pairs = holdout_pairs(window, holdout_year, models, cols).drop("sd", "base_year")
    scored = cut_lineage(pairs.join(fits.select("estimator", *cols.group, "sd"), list(cols.group)))
    return _measured(scored, next(iter(estimators.values())), ["estimator"])


def minority_share(results: DataFrame, group: Sequence[str] = ("county",)) -> DataFrame:
    """Cohort size and share of candidates who sat the third paper."""
    third = F.col("materna_h").isNotNull()
    return results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(third).alias("third_paper"),
        F.avg(third.cast("double")).alias("share"),
    )


def record_inflation(
    results: DataFrame,
    group: Sequence[str] = ("county",),
    quantiles: Sequence[float] = (0.1, 0.5, 0.9),
) -> DataFrame:
    """How far the school record lies above the exam average: mean and exact quantiles.

    The gaps are whole hundredths, so they fold to at most 1,801 values per group first.
    """
    gap = F.col("school_media_h") - F.col("media_h")
    counts = results.filter(gap.isNotNull()).groupBy(*group, gap.alias("gap_h")).agg(
        F.count(F.lit(1)).alias("n")
    )
    shares = ", ".join(f"{q}D" for q in quantiles)
    exact = F.expr(f"percentile(gap_h, array({shares}), n)")
    folded = counts.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum(F.col("gap_h") * F.col("n")).alias("_sum"), exact.alias("_q")
    )
    return folded.select(
        *group,
        "n",
        (F.col("_sum") / F.col("n") / 100).alias("mean_gap"),
        *[(F.col("_q")[i] / 100).alias(f"q{round(q * 100)}") for i, q in enumerate(quantiles)],
    )


def dataset_totals(offers: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """Rows and seats per year and group."""
    return offers.groupBy(cols.year, *cols.group).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(cols.seats).alias("total_seats")
    )
