import re

import pytest
from pyspark.sql import functions as F

from gradecut.functions import keys, marks, probability
from gradecut.sources import exams


def h(value):
    return F.lit(value).cast("bigint")


@pytest.mark.parametrize(
    "romana, matematica, third, expected",
    [(990, 981, None, 985), (570, 905, 310, 595), (165, 355, 355, 291), (1000, 999, None, 999), (990, 982, None, 986)],
)
def test_average_is_truncated(one, romana, matematica, third, expected):
    assert one(marks.exam_average_h(h(romana), h(matematica), h(third))) == expected


def test_average_over_the_whole_scale(spark):
    grid = spark.range(100, 1001).select(F.col("id").alias("a")).join(
        spark.range(100, 1001, 7).select(F.col("id").alias("b"))
    )
    wrong = grid.filter(marks.exam_average_h(F.col("a"), F.col("b")) != F.floor((F.col("a") + F.col("b")) / 2))
    assert wrong.count() == 0


def test_every_two_decimal_grade_is_exact(spark):
    grid = spark.range(100, 1001).select("id", (F.col("id") / 100).alias("x"))
    assert grid.filter(marks.to_hundredths(F.col("x")) != F.col("id")).count() == 0


@pytest.mark.parametrize("bad", [0.99, 10.01, 9.855, float("nan"), float("inf")])
def test_bad_grades(one, bad):
    assert one(marks.to_hundredths(F.lit(bad))) is None
    with pytest.raises(Exception, match="grade"):
        one(marks.to_hundredths(F.lit(bad), on_error="raise"))


@pytest.mark.parametrize(
    "value, expected", [(9.855, 9.85), (9.86, 9.86), (-9.855, -9.85), (9.999999, 9.99), (2.675, 2.67), (0.0, 0.0)]
)
def test_truncation_follows_the_decimals(one, value, expected):
    assert one(marks.truncate_two_decimals(F.lit(value))) == expected


@pytest.mark.parametrize(
    "cell, expected",
    [("9,85", 985), (" 9.859 ", 985), ("10", 1000), ("7,5", 750), ("-", None), ("n/a", None), ("—", None), (" 8,1 ", 810)],
)
def test_published_cells(one, cell, expected):
    assert one(marks.parse_media_cell(F.lit(cell))) == expected


@pytest.mark.parametrize("cell", ["abc", "11", "0,5", "9,8,5", "123"])
def test_unknown_cells_fail(one, cell):
    assert one(marks.media_cell_error(F.lit(cell))) is not None
    with pytest.raises(Exception, match="no mark|outside"):
        one(marks.parse_media_cell(F.lit(cell)))


@pytest.mark.parametrize(
    "typed, expected",
    [("9.855", 985), ("9,8", 980), ("10", 1000), ("10.00", 1000), ("10.001", None), ("11", None), ("0.9", None),
     ("x", None), ("", None), (" 7. ", 700), ("99999999999999999999", None)],
)
def test_typed_marks(one, typed, expected):
    assert one(marks.parse_media_input(F.lit(typed))) == expected


@pytest.mark.parametrize("mark, text", [(905, "9.05"), (1000, "10.00"), (None, "")])
def test_format(one, mark, text):
    assert one(marks.format_media_h(h(mark))) == text


@pytest.mark.parametrize("cell, expected", [("8.1300000000000008", 813), (" 9.9 ", 990), ("-", None), ("", None)])
def test_sheet_grades(one, cell, expected):
    assert one(marks.parse_sheet_grade(F.lit(cell))) == expected


@pytest.mark.parametrize("cell", ["abc", "0.5", "10.01"])
def test_bad_sheet_grades(one, cell):
    with pytest.raises(Exception, match="not a number|outside"):
        one(marks.parse_sheet_grade(F.lit(cell)))


@pytest.mark.parametrize(
    "row, status",
    [((990, 981, None, 985), "ok"), ((570, 905, 310, 595), "ok"), ((570, 905, None, 595), "mismatch"), ((None, 905, None, 595), "incomplete"), ((1, 2, 3, None), "incomplete")],
)
def test_media_status(one, row, status):
    assert one(marks.media_status(*[h(v) for v in row])) == status


@pytest.mark.parametrize("mark, knot", [(612, 600), (613, 625), (625, 625), (1000, 1000), (637, 625), (638, 650)])
def test_grid(one, mark, knot):
    assert one(marks.snap_to_grid_h(h(mark), 25)) == knot


def test_scale_position(one):
    assert one(marks.scale_position(F.lit(5.5))) == 50
    assert one(marks.scale_position(F.lit(None).cast("double"))) == 0
    assert one(marks.scale_position(F.lit(12.0))) == 100


@pytest.mark.parametrize("z, p", [(1.0, 0.8413447), (-1.0, 0.1586553), (1.2815515655446004, 0.9), (0.0, 0.5)])
def test_normal_cdf(one, z, p):
    assert one(probability.normal_cdf(F.lit(z))) == pytest.approx(p, abs=1e-5)
    assert one(probability.normal_cdf(F.lit(z))) == pytest.approx(probability.normal_cdf_value(z), abs=1e-15)


def test_a_mark_on_the_cutoff_counts_as_cleared(one):
    assert one(probability.normal_cdf(F.lit(0.0)) >= 0.5)


@pytest.mark.parametrize(
    "p, band",
    [(0.9, "sigur"), (0.89, "probabil"), (0.7, "probabil"), (0.3, "incert"), (0.1, "putin probabil"), (0.09, "improbabil"), (None, None)],
)
def test_bands(one, p, band):
    assert one(probability.chance_band(F.lit(p).cast("double"))) == band


def test_keys(one):
    assert one(keys.county_of_school(F.lit(" 4012345678"))) == "B"
    assert one(keys.county_of_school(F.lit("5112345678"))) == "CL"
    assert one(keys.county_of_school(F.lit("4112345678"))) is None
    assert one(keys.county_name(F.lit("SB"))) == "Sibiu"
    assert one(keys.county_name(F.lit("XX"))) == "XX"
    assert one(keys.course_label(F.lit("Mate"), F.lit("Engleză"), F.lit(True))) == "Mate (bilingv: Engleză) (dual)"
    assert one(keys.course_label(F.lit("Mate"), F.lit("-"), F.lit(False))) == "Mate"
    assert one(keys.comparable_years(F.lit(2022), F.lit(2023))) is False
    assert one(keys.comparable_years(F.lit(2024), F.lit(2023))) is True


@pytest.mark.parametrize("day, grade, latest, year", [("2026-08-31", 8, 2026, 2027), ("2026-09-01", 8, 2025, 2027), ("2026-09-01", 5, 2026, 2030)])
def test_target_year(one, day, grade, latest, year):
    assert one(keys.target_year(F.to_date(F.lit(day)), F.lit(grade), F.lit(latest))) == year


def test_unknown_occupancy_is_not_a_vacancy(one):
    assert one(keys.has_vacancies(F.lit(None).cast("int"), F.lit(28))) is False
    assert one(keys.has_vacancies(F.lit(19), F.lit(28))) is True
    assert one(keys.has_vacancies(F.lit(30), F.lit(28))) is False


def test_sheet_cells_as_one_by_one(spark):
    cells = ["8.1300000000000008", "\u00a0 9.9\u2003", "-", " ", None, "abc", "0.5", "10.01", "1e1", "5d", "NaN", "0x1p3", ".5e1"]
    df = spark.createDataFrame([(c, "7") for c in cells], "a string, b string")
    both = df.select(
        marks.sheet_cells("a", "b").alias("c"), marks.parse_sheet_grade(F.col("a"), "null").alias("h"),
        marks.sheet_grade_error(F.col("a")).alias("e"),
    ).collect()
    assert [(r["c"][0]["mark_h"], r["c"][0]["error"], r["c"][1]["mark_h"]) for r in both] == [(r["h"], r["e"], 700) for r in both]
    assert [r["h"] for r in both] == [813, 990, None, None, None, None, None, None, 1000, None, None, None, 500]


def largest_method(df):
    """Bytes of the largest method that a plan's generated code has."""
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = df._jdf.queryExecution().explainString(mode)
    return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text))


def test_code_is_small_enough_to_be_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows no code before it runs
    try:
        rows = spark.createDataFrame([("01", "URBAN", "7", "-", "8", "7.5", "9")], list(exams.RESULT_HEADINGS))
        parsed = exams.results_of(rows, strict=False)
        totals = parsed.groupBy("county", "urban", F.col("error").isNotNull()).agg(*[F.sum(g) for g in exams.GRADES])
        assert largest_method(totals) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
