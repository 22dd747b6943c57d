import math
import random

import pytest
from pyspark.sql import functions as F

from gradecut.operators import calibration, pupils
from gradecut.params import KNOTS_2025, CalibrationParams

RESULT = "school_id int, romana_h bigint, materna_h bigint, matematica_h bigint, media_h bigint, school_media_h bigint"


def results(spark, n=3000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        x = rng.choice([rng.randint(500, 1000), 1000, 870])
        r, m = (max(100, min(1000, x - 150 + rng.randint(-150, 150))) for _ in range(2))
        rows.append((i % 40, r if i % 50 else None, 700 if i % 11 == 0 else None, m, (r + m) // 2, x))
    return spark.createDataFrame(rows, RESULT), [r for r in rows if r[1] is not None and r[2] is None]


def brute_knots(rows, step, least):
    bins = {}
    for _, r, _, m, _, x in rows:
        bins.setdefault(math.floor(x / step + 0.5) * step, []).append((r, m))
    knots, carry = [], []
    for key in sorted(bins):
        carry = carry + bins[key]
        if len(carry) >= least:
            knots.append([key, carry])
            carry = []
    if carry and knots:
        knots[-1][1] = knots[-1][1] + carry
    out = []
    for key, pairs in knots:
        row = [key / 100, len(pairs)]
        for i in (0, 1):
            values = [p[i] / 100 for p in pairs]
            mean = sum(values) / len(values)
            row += [mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))]
        out.append(row)
    return out


def brute_value(knots, x, i):
    if x <= knots[0][0]:
        return knots[0][i]
    for lo, hi in zip(knots, knots[1:]):
        if x <= hi[0]:
            return lo[i] + (x - lo[0]) / (hi[0] - lo[0]) * (hi[i] - lo[i])
    return knots[-1][i]


@pytest.mark.parametrize("least", [1, 90, 150, 100000])
def test_knots_equal_brute_force(spark, least):
    df, rows = results(spark)
    sums = calibration.mark_sums(df)
    got = calibration.calibrate_knots(sums, params=CalibrationParams(min_count=least)).orderBy("school_media").collect()
    want = brute_knots(rows, 25, least)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert list(g) == pytest.approx(w)


def test_rho_and_effects_equal_brute_force(spark):
    df, rows = results(spark)
    knots, rho = calibration.calibrate(df)
    table = [list(r)[:1] + list(r)[1:] for r in knots.orderBy("school_media").collect()]
    er = [r / 100 - brute_value(table, x / 100, 2) for _, r, _, _, _, x in rows]
    em = [m / 100 - brute_value(table, x / 100, 4) for _, _, _, m, _, x in rows]
    n = len(rows)
    ar, am = sum(er) / n, sum(em) / n
    cov = sum((a - ar) * (b - am) for a, b in zip(er, em)) / n
    want = cov / math.sqrt(sum((a - ar) ** 2 for a in er) / n * sum((b - am) ** 2 for b in em) / n)
    assert rho.first()["subject_rho"] == pytest.approx(want)
    directory = spark.createDataFrame([(i,) for i in range(42)], "school_id int")
    effects = {r["school_id"]: r for r in calibration.group_effects(df, knots, directory=directory).collect()}
    mine = [e for e, row in zip(er, rows) if row[0] == 3]
    assert effects[3]["romana"] == pytest.approx(sum(mine) / (len(mine) + 30))
    assert effects[41]["n"] == 0 and effects[41]["romana"] == 0.0


def test_no_eligible_result_is_an_error(spark):
    with pytest.raises(ValueError, match="nobody"):
        calibration.calibrate(spark.createDataFrame([], RESULT))
    with pytest.raises(ValueError, match="no knots"):
        calibration.calibrate(results(spark, 500)[0], params=CalibrationParams(min_count=10**6))


def test_interpolation_clamps_and_hits_the_knots(spark):
    xs = [1.0, 5.99, 6.0, 6.1, 7.25, 8.62, 9.99, 10.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    cells = calibration.knot_cells(calibration.knots_2025(spark))
    joined = calibration.join_cells(df, cells, F.col("x"), "c_")
    got = {r["x"]: r["v"] for r in joined.select("x", calibration.interpolated(F.col("x"), "matematica", "c_").alias("v")).collect()}
    for x in xs:
        assert got[x] == pytest.approx(brute_value(KNOTS_2025, x, 3))


STUDENT = (
    "id int, current_grade int, school_record array<struct<grade:int,media:double>>, takes_mother_tongue boolean, "
    "mock_romana double, mock_matematica double, school_id string"
)


def predict(spark, rows, effects=None):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], STUDENT)
    return pupils.predict_marks(df, calibration.knots_2025(spark), effects).orderBy("id").collect()


def expected(record, subject, mock=None, offset=0.0):
    """The published formulas, one pupil at a time."""
    i = {"romana": 1, "matematica": 3}[subject]
    x = sum(m for _, m in record) / len(record)
    value = lambda at, j: brute_value(KNOTS_2025, at, j)
    measured = value(x, i + 1) ** 2
    drift = sum((0.25 * sum(g <= k for g, _ in record) / len(record)) ** 2 for k in (5, 6, 7))
    lo, hi = max(1, x - 0.125), min(10, x + 0.125)
    slope = (value(hi, i) - value(lo, i)) / (hi - lo)
    var = 0.55 * measured + drift + (slope * 0.3) ** 2 * max(0, 1 / len(record) - 0.25)
    mean = min(10, max(1, value(x, i) + offset))
    if mock is not None:
        w = 0.2025 / (var + 0.2025)
        mean, var = w * mean + (1 - w) * (mock + 0.35), var * 0.2025 / (var + 0.2025)
    return mean, math.sqrt(var + 0.45 * measured)


def test_golden_average(spark):
    row = predict(spark, [(8, [(5, 8.0), (8, 10.0)], False, None, None, None)])[0]
    assert row["school_mean"] == 9.0
    assert row["media_mean"] == pytest.approx(6.933, abs=1e-3)


def test_predictions_follow_the_formulas(spark):
    records = [
        (8, [(5, 8.1), (6, 8.4), (7, 9.0), (8, 9.3)], False, 7.5, 6.2, "A"),
        (5, [(5, 9.9)], False, None, None, "B"),
        (7, [(6, 7.1), (5, 6.0)], False, None, None, "A"),
        (8, [(8, 10.0)], False, None, 9.9, None),
    ]
    effects = spark.createDataFrame([("A", 0.4, -0.3)], "school_id string, romana double, matematica double")
    for row, (grade, record, _, mr, mm, school) in zip(predict(spark, records, effects), records):
        offsets = (0.4, -0.3) if school == "A" else (0.0, 0.0)
        r, sr = expected(record, "romana", mr, offsets[0])
        m, sm = expected(record, "matematica", mm, offsets[1])
        assert (row["romana_sd"], row["matematica_sd"]) == pytest.approx((sr, sm))
        assert row["media_mean"] == pytest.approx(min(10, max(1, (r + m) / 2)))
        assert row["media_sd"] == pytest.approx(math.sqrt(sr**2 + sm**2 + 2 * 0.443 * sr * sm) / 2)
        assert row["horizon_years"] == 8 - max(g for g, _ in record)
        assert row["romana_basis"] == ("school" if mr is None else "school+simulare")


def test_bad_records_are_kept_with_a_reason(spark):
    good = [(5, 8.0)]
    rows = [
        (4, good, False, None, None, None),
        (8, good, True, None, None, None),
        (8, good, None, None, None, None),
        (8, [], False, None, None, None),
        (8, [(9, 8.0)], False, None, None, None),
        (5, [(6, 8.0)], False, None, None, None),
        (8, [(5, 8.0), (5, 9.0)], False, None, None, None),
        (8, [(5, 10.5)], False, None, None, None),
        (8, [(5, float("nan"))], False, None, None, None),
        (7, good, False, 5.0, None, None),
        (8, good, False, 0.5, None, None),
    ]
    got = predict(spark, rows)
    assert all(r["error"] and r["media_mean"] is None and r["romana_low"] is None for r in got)
    assert predict(spark, [(8, good, False, None, None, None)])[0]["error"] is None
