"""Exam marks predicted from a school record, as pure column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradecut.functions.marks import clamp
from gradecut.operators.calibration import interpolated, join_cells, knot_cells
from gradecut.params import MARK_MAX, MARK_MIN, MAX_MARKS, MarksParams
from gradecut.session import checked_broadcast

SUBJECTS = ("romana", "matematica")


def record_error(
    grade: Column,
    record: Column,
    mother_tongue: Column,
    mock: dict[str, Column],
    params: MarksParams = MarksParams(),
) -> Column:
    """First reason a pupil's record cannot be used, or null.

    ``record`` is a short array of (grade, media), at most one per school grade if valid.
    """
    first, last = params.first_grade, params.exam_grade
    bad_mark = lambda v: v.isNull() | F.isnan(v) | (v < MARK_MIN) | (v > MARK_MAX)
    grades = F.transform(record, lambda e: e["grade"])
    any_mock = mock["romana"].isNotNull() | mock["matematica"].isNotNull()
    error = (
        F.when(grade.isNull() | ~grade.between(first, last), "current grade is not one of 5..8")
        .when(mother_tongue.isNull() | mother_tongue, "mother-tongue candidates are not supported")
        .when(record.isNull() | (F.size(record) == 0), "at least one yearly mark is required")
        .when(
            F.exists(record, lambda e: e["grade"].isNull() | ~e["grade"].between(first, last)),
            "a yearly mark is for a grade outside 5..8",
        )
        .when(F.exists(record, lambda e: e["grade"] > grade), "a yearly mark is for a future grade")
        .when(F.size(F.array_distinct(grades)) != F.size(grades), "two marks for one grade")
        .when(F.exists(record, lambda e: bad_mark(e["media"])), "a yearly mark is outside 1..10")
        .when(any_mock & (grade != last), "mock marks exist only in the exam grade")
    )
    for subject in SUBJECTS:
        value = mock[subject]
        error = error.when(value.isNotNull() & bad_mark(value), f"mock {subject} is outside 1..10")
    return error


def mean_record(record: Column) -> Column:
    """Equal-weight mean of the yearly marks."""
    total = F.aggregate(record, F.lit(0.0), lambda acc, e: acc + e["media"])
    return total / F.size(record)


def drift_variance(record: Column, params: MarksParams = MarksParams()) -> Column:
    """How far the pupil can move between the years summarised and the exam."""
    steps = F.sequence(F.lit(params.first_grade), F.lit(params.exam_grade - 1))
    behind = lambda k: F.size(F.filter(record, lambda e: e["grade"] <= k))
    share = lambda k: behind(k) / F.size(record)
    return F.aggregate(
        steps, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(params.drift_sd) * share(k), 2)
    )


def latest_mark(record: Column) -> Column:
    """The newest yearly mark: what reading the record at face value gives."""
    newest_last = F.array_sort(F.transform(record, lambda e: F.struct(e["grade"], e["media"])))
    return F.element_at(newest_last, -1)["media"]


def record_table(knots: DataFrame, params: MarksParams = MarksParams()) -> DataFrame:
    """The knot table prepared for records: one row per half-step cell of the scale.

    On such a cell the mean, the spread and the rise between half a step below and half a
    step above are all linear, so each is stored as its values at the cell's two ends and
    one equi-join serves them all. Knots must lie on the half-step grid.
    """
    h = params.slope_half_step
    first, last = int(MARK_MIN / h), int(MARK_MAX / h)
    nodes = knots.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("node"))
    x = F.col("node") * h
    joined = join_cells(nodes, knot_cells(knots), x, "_c_")
    values = {f: interpolated(x, f, "_c_") for f in ("romana", "romana_sd", "matematica", "matematica_sd")}
    nodes = joined.select("node", *[value.alias(name) for name, value in values.items()])
    # At most 73 rows: one per node of the scale, which is flat beyond its ends.
    order = Window.partitionBy(F.lit(0)).orderBy("node")
    at = lambda name, step: F.coalesce(
        F.lead(name, step).over(order) if step > 0 else F.lag(name, -step).over(order),
        F.last(name).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        if step > 0
        else F.col(name),
    )
    columns = [F.col("node").alias("_cell")]
    for subject in SUBJECTS:
        sd = f"{subject}_sd"
        columns += [
            F.col(subject).alias(f"_{subject}_0"),
            at(subject, 1).alias(f"_{subject}_1"),
            F.col(sd).alias(f"_{sd}_0"),
            at(sd, 1).alias(f"_{sd}_1"),
            (at(subject, 1) - at(subject, -1)).alias(f"_{subject}_rise_0"),
            (at(subject, 2) - F.col(subject)).alias(f"_{subject}_rise_1"),
        ]
    return nodes.select(*columns)


def predict_marks(
    students: DataFrame,
    knots: DataFrame,
    effects: DataFrame | None = None,
    school: str = "school_id",
    params: MarksParams = MarksParams(),
) -> DataFrame:
    """Both subjects and their average for every pupil, with 80% intervals.

    Invalid records keep their row with ``error`` set and null predictions. The knot table
    becomes a 73-row table joined once; ``effects`` is joined by school.
    """
    mock = {s: F.col(f"mock_{s}") for s in SUBJECTS}
    record = F.col("school_record")
    error = record_error(F.col("current_grade"), record, F.col("takes_mother_tongue"), mock, params)
    df = students.withColumn("error", error)
    ok = F.col("error").isNull()
    h = params.slope_half_step
    x = F.col("school_mean")
    df = df.withColumns(
        {
            "school_mean": F.when(ok, mean_record(record)),
            "_drift": F.when(ok, drift_variance(record, params)),
            "horizon_years": F.when(
                ok, F.lit(params.exam_grade) - F.array_max(F.transform(record, lambda e: e["grade"]))
            ),
        }
    ).withColumn("_cell", F.least(F.lit(int(MARK_MAX / h)), F.floor(x / h).cast("int")))
    df = df.join(checked_broadcast(record_table(knots, params), MAX_MARKS), "_cell", "left")
    if effects is not None:
        offsets = effects.select(school, *[F.col(s).alias(f"_offset_{s}") for s in SUBJECTS])
        df = df.join(offsets, school, "left")
    width = F.least(x + h, F.lit(MARK_MAX)) - F.greatest(x - h, F.lit(MARK_MIN))
    df = df.withColumns(
        {
            "_u": x / h - F.col("_cell"),
            "_width": width,
            "_excess": F.greatest(
                F.lit(0.0), 1.0 / F.when(ok, F.size(record)) - 1.0 / params.record_years
            ),
        }
    )
    between = lambda name: F.col(f"_{name}_0") + F.col("_u") * (F.col(f"_{name}_1") - F.col(f"_{name}_0"))
    steps: dict[str, Column] = {}
    for subject in SUBJECTS:
        offset = F.lit(0.0) if effects is None else F.coalesce(F.col(f"_offset_{subject}"), F.lit(0.0))
        steps[f"_mean_{subject}"] = clamp(between(subject) + offset)
        steps[f"_measured_{subject}"] = F.pow(between(f"{subject}_sd"), 2)
        slope = F.when(F.col("_width") > 0, between(f"{subject}_rise") / F.col("_width")).otherwise(0.0)
        steps[f"_short_{subject}"] = F.pow(slope * params.catalog_year_sd, 2) * F.col("_excess")
    df = df.withColumns(steps).withColumns(
        {
            f"_var_{s}": F.col(f"_measured_{s}") * (1 - params.exam_day_share)
            + F.col("_drift")
            + F.col(f"_short_{s}")
            for s in SUBJECTS
        }
    )
    # A mock exam is a second reading, weighted by precision.
    mock_var = params.mock_sd**2
    combined: dict[str, Column] = {}
    for s in SUBJECTS:
        var, seen = F.col(f"_var_{s}"), mock[s].isNotNull()
        weight = F.when(seen, mock_var / (var + mock_var)).otherwise(1.0)
        reading = F.when(seen, mock[s] + params.mock_uplift).otherwise(0.0)
        combined[f"_raw_{s}"] = weight * F.col(f"_mean_{s}") + (1 - weight) * reading
        combined[f"{s}_sd"] = F.sqrt(weight * var + F.col(f"_measured_{s}") * params.exam_day_share)
        basis = F.when(seen, "school+simulare").otherwise("school")
        combined[f"{s}_basis"] = F.when(ok, basis)
    df = df.withColumns(combined)
    sr, sm = F.col("romana_sd"), F.col("matematica_sd")
    df = df.withColumns(
        {
            "_raw_media": (F.col("_raw_romana") + F.col("_raw_matematica")) / 2,
            "media_sd": F.sqrt(sr * sr + sm * sm + 2 * params.subject_rho * sr * sm) / 2,
        }
    )
    outputs: list[Column] = []
    for name in (*SUBJECTS, "media"):
        raw, sd = F.col(f"_raw_{name}"), F.col(f"{name}_sd")
        outputs += [
            F.when(ok, clamp(raw)).alias(f"{name}_mean"),
            sd,
            F.when(ok, clamp(raw - sd * params.z)).alias(f"{name}_low"),
            F.when(ok, clamp(raw + sd * params.z)).alias(f"{name}_high"),
        ]
    return df.select(
        *students.columns, "error", "school_mean", "horizon_years", *outputs, *[f"{s}_basis" for s in SUBJECTS]
    )
