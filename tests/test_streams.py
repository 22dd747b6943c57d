import random

from pyspark.sql import functions as F

from gradecut.operators.evaluate import assert_media
from gradecut.streaming import streams

RESULT = "county string, romana_h bigint, materna_h bigint, matematica_h bigint, media_h bigint"


def test_verification_over_arriving_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = spark.createDataFrame([("SB", 990, None, 981, 985), ("SB", 570, 310, 905, 595)], RESULT)
    first.coalesce(1).write.parquet(source)
    run = lambda: streams.run_counts(
        streams.running_verification(streams.read_arriving(spark, source, first.schema)), out, state
    )
    run()
    read = lambda: {(r["status"], r["papers"]): r["n"] for r in streams.read_counts(spark, out).collect()}
    assert read() == {("ok", 2): 1, ("ok", 3): 1}
    spark.createDataFrame([("SB", 990, None, 981, 986), ("SB", 990, None, 981, 985)], RESULT).write.mode("append").parquet(source)
    run()
    assert read() == {("ok", 2): 2, ("ok", 3): 1, ("mismatch", 2): 1}
    try:
        assert_media(spark.read.parquet(source))
    except ValueError as error:
        assert "1 averages" in str(error)
    else:
        raise AssertionError("expected a mismatch")


def test_first_sight_of_pages(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df = spark.createDataFrame([("http://h.ro", "2026-01-01 00:00:00"), ("http://h.ro/", "2026-01-01 00:01:00")], "url string, at string")
    df = df.withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(source)
    for fetched in (None, "at"):
        kept = streams.first_seen_pages(streams.read_arriving(spark, source, df.schema), fetched_at=fetched)
        streams.run_available(kept, f"{out}{fetched}", f"{state}{fetched}")
        assert spark.read.parquet(f"{out}{fetched}").count() == 1
    df.write.mode("append").parquet(source)
    kept = streams.first_seen_pages(streams.read_arriving(spark, source, df.schema))
    streams.run_available(kept, f"{out}None", f"{state}None")
    assert spark.read.parquet(f"{out}None").count() == 1


def test_last_writes_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(20), n, f"v{n % 7}") for n in range(200)]
    rng.shuffle(rows)
    kind = "key int, seq int, value string"
    for turn in range(4):
        part = rows[turn * 50 : turn * 50 + 50]
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = streams.read_arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema, per_trigger=1)
        streams.run_last_writes(arriving, ["key"], "seq", str(tmp_path / "out"), str(tmp_path / "state"))
        got = streams.read_last_writes(spark, ["key"], str(tmp_path / "out"))
        want = {}
        for k, n, v in sorted(rows[: turn * 50 + 50], key=lambda r: r[1]):
            want[k] = (n, v)
        assert {r["key"]: (r["seq"], r["value"]) for r in got.collect()} == want
    # a batch that was written and never finished does not count
    spark.createDataFrame([(0, 10**6, "x")], kind).write.parquet(str(tmp_path / "out/batches/batch=999"))
    assert streams.read_last_writes(spark, ["key"], str(tmp_path / "out")).filter("value = 'x'").isEmpty()
