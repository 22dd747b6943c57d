"""The cutoff model: fit every group at once, score requests, list and summarise answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradecut.functions import keys, probability
from gradecut.functions.marks import scale_position
from gradecut.operators.columns import OfferCols
from gradecut.operators.matching import yearly_deltas
from gradecut.operators.ranking import rank_within
from gradecut.operators.robust import array_median, weighted_median
from gradecut.params import MAX_COUNTIES, Z_80, CutoffParams
from gradecut.session import checked_broadcast


def delta_histogram(offers: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """Group, year, ``delta_h`` and its count ``n``, with the median ``shift_h`` of the year.

    Marks are whole hundredths, so a group and year has at most 1,801 different deltas:
    from here on the tables are small whatever the size of the offers. Years without a
    matched pair keep one row with a null delta.
    """
    group = list(cols.group)
    counts = (
        yearly_deltas(offers, cols)
        .groupBy(*group, "year", "delta_h")
        .agg(F.count(F.lit(1)).alias("n"))
        # One exchange serves the per-year and the per-group steps that follow.
        .repartition(*[F.col(c) for c in group])
    )
    per_year = Window.partitionBy(*group, "year")
    paired = F.when(F.col("delta_h").isNotNull(), F.col("n"))
    return counts.withColumns(
        {
            "shift_h": weighted_median("delta_h", "n").over(per_year),
            "spec_count": F.coalesce(F.sum(paired).over(per_year), F.lit(0)),
        }
    )


def county_shifts(offers: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """Median change and number of matched courses per group and pair of adjacent years."""
    return (
        delta_histogram(offers, cols)
        .filter(F.col("shift_h").isNotNull())
        .groupBy(*cols.group, "year")
        .agg((F.first("shift_h") / 100).alias("shift"), F.first("spec_count").alias("spec_count"))
    )


def fit_cutoff_model(
    offers: DataFrame,
    target_year: int,
    cols: OfferCols = OfferCols(),
    params: CutoffParams = CutoffParams(),
) -> DataFrame:
    """One row per group: spreads, evidence and observed shifts for ``target_year``.

    ``step_sd`` is the spread of one year's step, ``sd`` that of the whole horizon. Run
    ``contracts.history_violations`` first: this does not check the years.
    """
    return fit_histogram(delta_histogram(offers, cols), target_year, cols, params)


def fit_histogram(
    histogram: DataFrame,
    target_year: int,
    cols: OfferCols = OfferCols(),
    params: CutoffParams = CutoffParams(),
) -> DataFrame:
    """The fit from a ready ``delta_histogram``, so that several fits read the offers once.

    Keeping only the years before a holdout in the histogram is the same as fitting on
    those years' offers.
    """
    group = list(cols.group)
    per_group = Window.partitionBy(*group)
    deltas = histogram.withColumn("resid_h", F.col("delta_h") - F.col("shift_h"))
    centred = deltas.withColumns(
        {
            "_resid_mid": weighted_median("resid_h", "n").over(per_group),
            "_delta_mid": weighted_median("delta_h", "n").over(per_group),
        }
    ).withColumns(
        {
            "_resid_dev": F.abs(F.col("resid_h") - F.col("_resid_mid")),
            "_delta_dev": F.abs(F.col("delta_h") - F.col("_delta_mid")),
        }
    )
    shift = F.struct("year", (F.col("shift_h") / 100).alias("shift"), "spec_count")
    fitted = centred.groupBy(*group).agg(
        F.max("year").alias("base_year"),
        F.sum(F.when(F.col("delta_h").isNotNull(), F.col("n"))).alias("_n"),
        weighted_median("_resid_dev", "n").alias("_resid_mad"),
        weighted_median("_delta_dev", "n").alias("_delta_mad"),
        # At most one entry per year of history.
        F.array_sort(F.collect_set(F.when(F.col("shift_h").isNotNull(), shift))).alias("observed_shifts"),
    )
    scale = params.mad_factor
    fitted = (
        fitted.withColumns(
            {
                "_k": F.size("observed_shifts"),
                "_shifts": F.array_sort(F.transform("observed_shifts", lambda s: s["shift"])),
            }
        )
        .withColumn("_shift_mid", array_median(F.col("_shifts")))
        .withColumn(
            "_shift_devs", F.array_sort(F.transform("_shifts", lambda s: F.abs(s - F.col("_shift_mid"))))
        )
    )
    k = F.col("_k")
    tau_mad = array_median(F.col("_shift_devs"))
    reliable = F.filter("observed_shifts", lambda s: s["spec_count"] >= params.reliable_courses)
    squares = F.aggregate(reliable, F.lit(0.0), lambda acc, s: acc + s["shift"] * s["shift"])
    rms = F.when(F.size(reliable) > 0, F.sqrt(squares / F.size(reliable)))
    bessel = F.sqrt(k / F.greatest(F.lit(1), k - 1))
    fitted = fitted.withColumns(
        {
            "_sigma_e": F.when(F.col("_n") >= params.min_residuals, F.col("_resid_mad") / 100 * scale),
            "_tau_e": F.when(k >= params.min_shifts, tau_mad * scale),
            "_pooled": F.when(k >= params.min_shifts, F.col("_delta_mad") / 100 * scale * bessel),
            "_rms": rms,
        }
    )
    sigma_prior, tau_prior = F.lit(params.sigma_prior), F.lit(params.tau_prior)
    short = F.col("_pooled").isNull()
    sigma_seen = F.coalesce("_sigma_e", sigma_prior)
    if params.short_history == "fixed_prior":
        short_sigma, short_tau = sigma_seen, tau_prior
    else:
        short_sigma = F.greatest(sigma_prior, sigma_seen)
        short_tau = F.coalesce(F.greatest(tau_prior, F.col("_rms")), tau_prior)
    fitted = fitted.withColumns(
        {
            "target_year": F.lit(target_year),
            "sigma": F.when(short, short_sigma).otherwise(sigma_seen),
            "tau": F.when(short, short_tau).otherwise(F.coalesce("_tau_e", tau_prior)),
            "evidence": F.when(short, "prior").otherwise("estimated"),
        }
    ).withColumn(
        "step_sd",
        F.greatest(F.lit(params.min_sd), F.coalesce("_pooled", F.hypot("tau", "sigma"))),
    )
    sd = probability.horizon_sd(F.col("step_sd"), F.col("target_year"), F.col("base_year"))
    return fitted.withColumn("sd", sd).select(
        *group, "target_year", "base_year", "sigma", "tau", "step_sd", "sd", "evidence", "observed_shifts"
    )


def base_courses(
    offers: DataFrame,
    models: DataFrame,
    cols: OfferCols = OfferCols(),
    max_groups: int = MAX_COUNTIES,
) -> DataFrame:
    """Offers of each group's base year with the group's model columns.

    One row per group in ``models``, which is broadcast only if it is counted to be as
    short as the county contract allows.
    """
    small = checked_broadcast(models.select(*cols.group, "base_year", "step_sd", "sd"), max_groups)
    return offers.join(small, list(cols.group)).filter(F.col(cols.year) == F.col("base_year"))


def _prediction(
    known: Column,
    cols: OfferCols,
    media: Column,
    media_sd: Column | None,
    sd: Column,
    z: float,
) -> dict[str, Column]:
    """Prediction columns in the fixed order of checks: unknown, vocational, vacant, no mark."""
    vacant = keys.has_vacancies(F.col(cols.occupied), F.col(cols.seats))
    reason = (
        F.when(~known, "no-history")
        .when(F.col(cols.vocational), "vocational")
        .when(vacant, F.lit(None).cast("string"))
        .when(F.col(cols.mark_h).isNull(), "no-cutoff")
    )
    kind = (
        F.when(reason.isNotNull(), "unavailable").when(vacant, "open").otherwise("estimate")
    )
    cutoff = F.when(F.col("kind") == "estimate", F.col(cols.mark_h) / 100)
    total = sd if media_sd is None else F.hypot(sd, F.coalesce(media_sd, F.lit(0.0)))
    chance = F.coalesce(probability.normal_cdf(F.col("_z")), F.lit(0.5))
    return {
        "reason": reason,
        "kind": kind,
        "cutoff": cutoff,
        "_z": (media - F.col("cutoff")) / total,
        "probability": F.when(F.col("kind") == "estimate", chance),
        "interval_low": probability.interval_low(F.col("cutoff"), sd, z),
        "interval_high": probability.interval_high(F.col("cutoff"), sd, z),
        "prediction_sd": F.when(F.col("kind") == "estimate", sd),
    }


def _with_prediction(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    df = df.withColumns({"reason": parts["reason"], "kind": parts["kind"]})
    df = df.withColumn("cutoff", parts["cutoff"])
    # a column of its own: the distribution function names it many times, and code of over 8,000 bytes is never compiled
    df = df.withColumn("_z", parts["_z"])
    rest = ("probability", "interval_low", "interval_high", "prediction_sd")
    df = df.withColumns({name: parts[name] for name in rest})
    rank = (
        F.when(F.col("kind") == "estimate", F.col("probability"))
        .when(F.col("kind") == "open", -0.5)
        .otherwise(-1.0)
    )
    return df.withColumns({"rank_value": rank, "band": probability.chance_band(F.col("probability"))})


PREDICTION = (
    "kind", "reason", "probability", "cutoff", "interval_low", "interval_high", "prediction_sd",
    "rank_value", "band",
)


def score_requests(
    requests: DataFrame,
    offers: DataFrame,
    models: DataFrame,
    cols: OfferCols = OfferCols(),
    media: str = "media",
    media_sd: str | None = None,
    target_year: str | None = None,
    z: float = Z_80,
) -> DataFrame:
    """Score each request against the one course it names; unknown keys are 'no-history'.

    ``requests`` carries the group and key columns and a mark; ``media_sd`` widens the
    answer for an estimated mark and ``target_year`` overrides the models' horizon row by
    row. One equi-join, linear in the requests.
    """
    facts = [cols.mark_h, cols.seats, cols.occupied, cols.vocational]
    courses = base_courses(offers, models, cols).select(
        *cols.group, *cols.key, *facts, "base_year", "step_sd", "sd", F.lit(True).alias("_known")
    )
    joined = requests.join(courses, [*cols.group, *cols.key], "left")
    sd = F.col("sd")
    if target_year is not None:
        sd = probability.horizon_sd(F.col("step_sd"), F.col(target_year), F.col("base_year"))
    spread = None if media_sd is None else F.col(media_sd)
    parts = _prediction(F.col("_known").isNotNull(), cols, F.col(media), spread, sd, z)
    return _with_prediction(joined, parts).select(*requests.columns, *PREDICTION)


def score_courses(
    questions: DataFrame,
    offers: DataFrame,
    models: DataFrame,
    cols: OfferCols = OfferCols(),
    media: str = "media",
    media_sd: str | None = None,
    z: float = Z_80,
) -> DataFrame:
    """Every course of a question's group, scored: one family's full list.

    Repeated questions are answered once, so on marks in hundredths a group has at most
    901 of them and the result grows with the courses only. For whole cohorts use
    ``answers.summaries`` and ``answers.best_courses``, which never form the product.
    """
    extra = [media] + ([media_sd] if media_sd else [])
    asked = questions.select(*cols.group, *extra).distinct()
    courses = base_courses(offers, models, cols)
    joined = courses.join(asked, list(cols.group))
    spread = None if media_sd is None else F.col(media_sd)
    parts = _prediction(F.lit(True), cols, F.col(media), spread, F.col("sd"), z)
    return _with_prediction(joined, parts).select(
        *cols.group, *extra, *cols.key_and_name, cols.seats, *PREDICTION
    )


def answer_bucket(media: Column) -> Column:
    """Where a prediction stands in the list: aside, open, above or below."""
    return (
        F.when(F.col("kind") == "unavailable", "aside")
        .when(F.col("kind") == "open", "open")
        .when(media.isNull() | (F.col("probability") >= 0.5), "above")
        .otherwise("below")
    )


def answer_list(
    predictions: DataFrame,
    question: Sequence[str],
    cols: OfferCols = OfferCols(),
    media: str = "media",
    romanian: bool = True,
) -> DataFrame:
    """Predictions in buckets, each ordered as the list is read; ``position`` starts at 0.

    Above: hardest to reach first. Below: nearest miss first. Open: most seats first.
    Aside: by name. Ties go by name, then by course key.
    """
    bucket = answer_bucket(F.col(media))
    in_order = (
        F.when(F.col("bucket") == "above", -F.col("cutoff"))
        .when(F.col("bucket") == "below", F.col("cutoff"))
        .when(F.col("bucket") == "open", -F.col(cols.seats).cast("double"))
        .otherwise(0.0)
    )
    placed = predictions.withColumn("bucket", bucket).withColumn("_order", in_order)
    name = F.collate(F.col(cols.name), "ro") if romanian else F.col(cols.name)
    order = [F.col("_order"), name, *[F.col(c) for c in cols.key]]
    ranked = rank_within(placed, [*question, "bucket"], order, "position", "bucket_size")
    low, high = F.col("interval_low"), F.col("interval_high")
    return ranked.drop("_order").withColumns(
        {
            "cutoff_pos": F.when(F.col("cutoff").isNotNull(), scale_position(F.col("cutoff"))),
            "fill": F.when(F.col("cutoff").isNotNull(), scale_position(F.col(media), low, high)),
        }
    )


def answer_summary(predictions: DataFrame, question: Sequence[str]) -> DataFrame:
    """Counts per question: answerable, cleared, too tight to call, open and set aside."""
    estimate = F.col("kind") == "estimate"
    return predictions.groupBy(*question).agg(
        F.count_if(estimate).alias("answerable"),
        F.count_if(estimate & (F.col("probability") >= 0.5)).alias("clears"),
        F.count_if(estimate & (F.col("band") == "incert")).alias("tight"),
        F.count_if(F.col("kind") == "open").alias("open"),
        F.count_if(F.col("kind") == "unavailable").alias("aside"),
    )
