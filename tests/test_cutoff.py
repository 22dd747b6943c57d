import math
import random

import pytest
from pyspark.sql import functions as F

from gradecut.functions.probability import normal_cdf_value
from gradecut.operators import answers, contracts, cutoff, evaluate, matching, robust
from gradecut.operators.columns import OfferCols
from gradecut.params import CutoffParams
from gradecut.plans.workloads import rounded
from gradecut.schemas import OFFER
from tests.test_marks import largest_method

COLS = OfferCols()


def offer(year, i, mark, county="SB", label=None, spec=None, seats=28, occupied=28, track="teoretica", school="S1"):
    return (
        year, county, school, f"Liceul {school}", spec or f"{year}-{i}", label or f"Course {i}", "Real", track,
        "Limba română", seats, occupied, mark, track == "vocationala",
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, OFFER)


def history(spark, shifts, count=20, start=2025):
    rows, mark = [], 700
    for step, shift in enumerate([0, *shifts]):
        mark += shift
        rows += [offer(start + step, i, mark) for i in range(count)]
    return frame(spark, rows)


def fit(df, target, **kwargs):
    return cutoff.fit_cutoff_model(df, target, COLS, CutoffParams(**kwargs)).first()


def test_counties_are_told_apart(spark):
    """SB moves by 0.55 in fifteen courses, BV stands still, CJ moves in three courses only."""
    rows = []
    for county, courses, moved in (("SB", 15, 55), ("BV", 15, 0), ("CJ", 3, 55)):
        for i in range(courses):
            rows += [offer(2030, i, 620 + 11 * i, county=county), offer(2031, i, 620 + 11 * i + moved, county=county)]
    models = {m["county"]: m for m in cutoff.fit_cutoff_model(frame(spark, rows), 2032, COLS, CutoffParams()).collect()}
    assert models["SB"]["tau"] == pytest.approx(0.55) and models["SB"]["sd"] == pytest.approx(math.sqrt(0.365))
    assert [tuple(s) for s in models["SB"]["observed_shifts"]] == [(2031, 0.55, 15)]
    for quiet in ("BV", "CJ"):
        assert models[quiet]["tau"] == 0.2 and models[quiet]["sd"] == pytest.approx(math.sqrt(0.1025))
    assert {m["evidence"] for m in models.values()} == {"prior"}


def test_two_shifts_add_as_squares(spark):
    """0.3 up and 0.1 up: the mean square is 0.05, not the square of the mean."""
    model = fit(history(spark, [30, 10], count=12, start=2028), 2031)
    assert model["tau"] == pytest.approx(math.sqrt(0.05)) and model["evidence"] == "prior"


def test_the_older_estimator_keeps_tau_at_its_prior(spark):
    assert fit(history(spark, [80]), 2027, short_history="fixed_prior")["tau"] == 0.2


def test_four_years_double_the_spread(spark):
    df = history(spark, [30])
    assert fit(df, 2030)["sd"] == pytest.approx(2 * fit(df, 2027)["sd"])


def test_pooled_errors_take_over_after_three_shifts(spark):
    marks = {i: [700 + 7 * i + d for d in (0, 10 + i, -20 + 2 * i, 5 * i)] for i in range(12)}
    df = frame(spark, [offer(2023 + y, i, m) for i, ms in marks.items() for y, m in enumerate(ms)])
    model = fit(df, 2027)

    def median(values):
        values = sorted(values)
        n = len(values)
        return (values[(n - 1) // 2] + values[n // 2]) / 2

    def mad(values):
        mid = median(values)
        return 1.4826 * median([abs(v - mid) for v in values])

    deltas = [[(ms[y] - ms[y - 1]) / 100 for ms in marks.values()] for y in (1, 2, 3)]
    shifts = [median(d) for d in deltas]
    assert model["evidence"] == "estimated"
    assert model["sd"] == pytest.approx(mad([d for ds in deltas for d in ds]) * math.sqrt(3 / 2))
    assert model["sigma"] == pytest.approx(mad([d - s for ds, s in zip(deltas, shifts) for d in ds]))
    assert model["tau"] == pytest.approx(mad(shifts))


def test_gaps_ambiguity_vacancies_and_aptitude_make_no_delta(spark):
    rows = [
        offer(2024, 0, 700), offer(2026, 0, 710),                                   # a gap
        offer(2025, 1, 700), offer(2026, 1, 720),                                   # counts
        offer(2025, 2, 700), offer(2025, 2, 701, spec="again"), offer(2026, 2, 720),  # ambiguous before
        offer(2025, 3, 700, occupied=20), offer(2026, 3, 720),                      # vacant before
        offer(2025, 4, 700, track="vocationala"), offer(2026, 4, 720, track="vocationala"),
        offer(2025, 5, None), offer(2026, 5, 720),                                  # unpublished
        offer(2025, 6, 700, label="Ştiinţe"), offer(2026, 6, 730, label="ȘTIINȚE"),  # same course
    ]
    deltas = matching.yearly_deltas(frame(spark, rows)).filter("delta_h is not null")
    assert sorted(r["delta_h"] for r in deltas.collect()) == [20, 30]
    kept = matching.unique_courses(frame(spark, rows)).filter("spec_label = 'Course 2'")
    assert [r["year"] for r in kept.collect()] == [2026]


def test_all_counties_at_once_equal_each_alone(spark):
    a, b = history(spark, [10]), history(spark, [-70]).withColumn("county", F.lit("BV"))
    both = {r["county"]: r for r in cutoff.fit_cutoff_model(a.unionByName(b), 2027).collect()}
    assert both["SB"]["sd"] == fit(a, 2027)["sd"]
    assert both["BV"]["sd"] == fit(b, 2027)["sd"]


def listing(spark):
    rows = [offer(2025, i, 600 + 15 * i) for i in range(20)]
    rows += [offer(2026, i, 610 + 15 * i) for i in range(20)]
    rows += [
        offer(2026, 30, 700, occupied=19, track="vocationala"),
        offer(2026, 31, 605, occupied=19),
        offer(2026, 32, None, occupied=19),
        offer(2026, 33, None),
        offer(2026, 34, 700, occupied=None),
        offer(2026, 35, 700, label="Twin", school="S0"),
    ]
    return frame(spark, rows)


def test_kinds_are_decided_in_order(spark):
    df = listing(spark)
    models = cutoff.fit_cutoff_model(df, 2027)
    asked = spark.createDataFrame(
        [("SB", "S1", f"2026-{i}", m) for i, m in ((30, 9.0), (31, 5.0), (32, 9.0), (33, 9.0), (34, None), (99, 9.0))],
        "county string, school_code string, spec_id string, media double",
    )
    got = {r["spec_id"][5:]: r for r in cutoff.score_requests(asked, df, models).collect()}
    assert (got["30"]["kind"], got["30"]["reason"]) == ("unavailable", "vocational")
    assert got["31"]["kind"] == "open" and got["32"]["kind"] == "open"
    assert (got["33"]["kind"], got["33"]["reason"]) == ("unavailable", "no-cutoff")
    assert got["34"]["kind"] == "estimate" and got["34"]["probability"] == 0.5
    assert (got["99"]["kind"], got["99"]["reason"]) == ("unavailable", "no-history")
    assert got["34"]["interval_high"] == pytest.approx(7 + 1.2815515655446004 * models.first()["sd"])


def test_an_uncertain_mark_pulls_toward_one_half(spark):
    df = listing(spark)
    models = cutoff.fit_cutoff_model(df, 2027)
    asked = spark.createDataFrame(
        [("SB", "S1", "2026-3", 8.0, 0.0, 2027), ("SB", "S1", "2026-3", 8.0, 0.9, 2027), ("SB", "S1", "2026-3", 8.0, 0.0, 2030)],
        "county string, school_code string, spec_id string, media double, media_sd double, target int",
    )
    got = cutoff.score_requests(asked, df, models, media_sd="media_sd", target_year="target").collect()
    sd = models.first()["step_sd"]
    expect = [(0.0, sd), (0.9, sd), (0.0, 2 * sd)]
    for row, (spread, step) in zip(sorted(got, key=lambda r: (r["target"], r["media_sd"])), expect):
        assert row["probability"] == pytest.approx(normal_cdf_value((8.0 - 6.55) / math.hypot(step, spread)))


def test_lookups_equal_scoring_every_course(spark):
    df = listing(spark)
    models = cutoff.fit_cutoff_model(df, 2027)
    asked = spark.createDataFrame(
        [("SB", m / 100, s) for m in (100, 600, 609, 610, 611, 750, 812, 1000) for s in (0.0, 0.37)] + [("SB", None, 0.0)],
        "county string, media double, media_sd double",
    )
    scored = cutoff.score_courses(asked, df, models, media_sd="media_sd")
    slow = cutoff.answer_summary(scored, ["county", "media", "media_sd"]).collect()
    fast = answers.summaries(asked, df, models, media_sd="media_sd").collect()
    key = lambda r: (r["media"] is None, r["media"], r["media_sd"])
    assert [tuple(r) for r in sorted(slow, key=key)] == [tuple(r) for r in sorted(fast, key=key)]


def test_best_courses_equal_the_head_of_the_list(spark):
    df = listing(spark)
    models = cutoff.fit_cutoff_model(df, 2027)
    asked = spark.createDataFrame([("SB", m / 100) for m in (600, 610, 700, 703, 900)], "county string, media double")
    listed = cutoff.answer_list(cutoff.score_courses(asked, df, models), ["county", "media"])
    slow = listed.filter("bucket = 'above' and position < 4").select("media", "position", "school_code", "spec_id")
    every = answers.best_courses(asked, df, models, 4)
    assert {r["media"] for r in every.collect()} == {6.0, 6.1, 7.0, 7.03, 9.0}  # one row at least for each
    fast = every.filter("position is not null").select("media", F.col("position") - 1, "course_school_code", "course_spec_id")
    assert sorted(map(tuple, slow.collect())) == sorted(map(tuple, fast.collect()))


def test_list_order(spark):
    df = listing(spark)
    models = cutoff.fit_cutoff_model(df, 2027)
    asked = spark.createDataFrame([("SB", 7.0)], "county string, media double")
    rows = cutoff.answer_list(cutoff.score_courses(asked, df, models), ["county", "media"]).collect()
    by = lambda b: sorted((r for r in rows if r["bucket"] == b), key=lambda r: r["position"])
    above, below = by("above"), by("below")
    assert [r["cutoff"] for r in above] == sorted((r["cutoff"] for r in above), reverse=True)
    assert above[0]["cutoff"] == 7.0 and above[0]["school_code"] == "S0"
    assert [r["cutoff"] for r in below] == sorted(r["cutoff"] for r in below)
    assert len(by("open")) == 2 and len(by("aside")) == 2
    assert all(r["position"] == i for b in ("above", "below", "open", "aside") for i, r in enumerate(by(b)))


def test_history_guards(spark):
    df = history(spark, [10])
    contracts.assert_history(df, 2027)
    with pytest.raises(contracts.ContractError, match="not after"):
        contracts.assert_history(df, 2026)
    with pytest.raises(contracts.ContractError, match="comparable"):
        contracts.assert_history(history(spark, [10], start=2021), 2027)
    with pytest.raises(contracts.ContractError, match="integer"):
        contracts.assert_history(df, float("nan"))
    with pytest.raises(contracts.ContractError, match="no history to fit"):
        contracts.assert_history(df.limit(0), 2027)
    twice = df.withColumn("file", F.lit("a")).unionByName(df.filter("year = 2026").withColumn("file", F.lit("b")))
    with pytest.raises(contracts.ContractError, match="twice"):
        contracts.assert_history(twice, 2027, dataset="file")


def test_audit_and_backtest(spark):
    df = history(spark, [10, -60]).unionByName(history(spark, [0, 5]).withColumn("county", F.lit("BV")))
    audit = {r["county"]: r for r in evaluate.forecast_audit(df, 2027).collect()}
    assert audit["SB"]["matched"] == 20 and audit["SB"]["covered"] == 0
    assert audit["BV"]["covered"] == 20 and audit["SB"]["observed_shift"] == pytest.approx(-0.6)
    assert audit[None]["matched"] == 40 and audit[None]["coverage"] == 0.5
    assert audit[None]["mae"] == pytest.approx((0.6 + 0.05) / 2)
    result = evaluate.backtest(df, 2027).first()
    assert result["n"] == 40 and result["samples"] == 200 and result["coverage"] == 0.5
    compared = {r["estimator"]: r for r in evaluate.compare_estimators(df, 2027).collect()}
    assert set(compared) == {"fixed_prior", "floored"}


def test_course_history(spark):
    rows = [
        offer(2026, 1, 700), offer(2025, 1, 690, spec="x"), offer(2024, 1, 680), offer(2022, 1, 600),
        offer(2024, 1, 650, spec="copy"), offer(2025, 1, 600, county="BV"), offer(2025, 9, 600, spec="2026-1"),
    ]
    df = frame(spark, rows)
    saved = df.filter("year = 2026").withColumn("saved_id", F.lit("a"))
    got = matching.course_history(saved, df).orderBy("history_rank").collect()
    assert [(r["year"], r["spec_id"]) for r in got] == [(2026, "2026-1"), (2025, "x")]


def test_selection_of_any_doubles(spark):
    rng = random.Random(4)
    groups = {
        "one": [5.0],
        "equal": [2.5] * 400,
        "spread": [rng.gauss(0, 1e6) for _ in range(700)],
        "steep": [10.0 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(600)],
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324] * 60,
        "hot": [1.0 + 2**-52 * rng.randrange(3) for _ in range(3000)],
        "odd": [None, float("nan")],
    }
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, x double")
    ranks = [(g, r) for g, xs in groups.items() if g != "odd" for r in {0, len(xs) // 3, len(xs) // 2, len(xs) - 1}]
    found = robust.order_statistics(rows, spark.createDataFrame(ranks, "g string, rank long"), ["g"], "x", held=20).collect()
    assert {(r["g"], r["rank"]): r["value"] for r in found} == {(g, r): sorted(groups[g])[r] for g, r in ranks}
    scale = robust.selected_scale(rows.filter("g IN ('spread', 'equal')"), ["g"], "x", held=20).collect()
    want = robust.robust_scale(rows.filter("g IN ('spread', 'equal')"), "x", ["g"]).collect()
    for a, b in zip(sorted(scale), sorted(want), strict=True):
        assert a["g"] == b["g"] and abs(a["median"] - b["median"]) < 1e-6 and abs(a["robust_scale"] - b["robust_scale"]) < 1e-6
    assert robust.grouped_quantiles(rows.limit(0), ["g"], "x", {"q": 0.5}).count() == 0


def test_one_sketch_for_all_cursors_of_a_range(spark, monkeypatch):
    rows = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("x"))
    shared = []

    def counting(df, most):
        shared.append(df.count())
        return df

    monkeypatch.setattr(robust, "checked_broadcast", counting)
    ranks = spark.createDataFrame([("a", r) for r in range(0, 1000, 100)], "g string, rank long")
    found = robust.order_statistics(rows, ranks, ["g"], "x", held=20).collect()
    assert {(r["rank"], r["value"]) for r in found} == {(r, float(r)) for r in range(0, 1000, 100)}
    assert shared[0] == 1  # the sketch's rows are joined with one range, not with ten cursors


def test_score_code_is_small_enough_to_be_compiled(spark):
    names = ("county", "school", "spec_id")
    asked = spark.createDataFrame([("A", "s", "1", 7.0, 0.5, 2002)], [*names, "media", "media_sd", "admission_year"])
    kind = "county string, school string, spec_id string, year int, seats int, occupied long, vocational boolean, last_media_h long"
    offers = spark.createDataFrame([("A", "s", "1", 2001, 5, 9, False, 650)], kind)
    models = spark.createDataFrame([("A", 2001, 0.3, 0.4)], "county string, base_year int, step_sd double, sd double")
    cols = OfferCols(key=("school", "spec_id"), occupied="occupied", name="school")
    scored = cutoff.score_requests(asked, offers, models, cols, media_sd="media_sd", target_year="admission_year")
    shown = rounded(scored.select(*names, "kind", "reason", "probability", "interval_low", "interval_high", "band"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows no code before it runs
    try:
        assert largest_method(shown) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert shown.first()["probability"] == round(normal_cdf_value(0.5 / math.hypot(0.3, 0.5)), 6)
