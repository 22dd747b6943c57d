import json

import pytest
from pyspark.sql import functions as F

from gradecut import cut_lineage
from gradecut.operators import contracts, sets
from gradecut.operators.calibration import knots_2025
from gradecut.schemas import EXAM_SAMPLE
from gradecut.sources import archive, exams, pages, publication, shortlists, sinks
from tests.test_cutoff import frame, offer

URL = "https://static.admitere.edu.ro/{year}/repartizare/{county}/data/specialization.json"


def record(**changes):
    base = dict(
        j="SB", c="101", l="Colegiul  Şaguna", lc="3261100001", m="URBAN", sp="Matematică", lp="Limba română", lb="-",
        nlt="28", nlo="28", fi="Zi", p="Real", f="Teoretică", n="Liceal", um="9.255", uma="1.00",
    )
    base.update(changes)
    return {k: v for k, v in base.items() if v != "absent"}


def store(tmp_path, year, county, records, url=None):
    (tmp_path / f"{year}-{county}.json").write_text(json.dumps(records), encoding="utf8")
    (tmp_path / f"{year}-{county}.json.url").write_text((url or URL.format(year=year, county=county)) + "\n")


def test_archive(spark, tmp_path):
    store(tmp_path, 2025, "SB", [record(), record(c="102", lb="Engleză", um=None, nlo="20")])
    store(tmp_path, 2026, "SB", [record(n="absent", d="DA", um="9,1")])
    (tmp_path / "notes.json").write_text("[]")
    parsed = archive.parse_records(archive.read_snapshots(spark, str(tmp_path)))
    contracts.assert_clean(archive.record_violations(parsed), "archive")
    rows = {(r["year"], r["spec_id"]): r for r in archive.offers_of(parsed).collect()}
    assert rows[2025, "101"]["school_name"] == "Colegiul Șaguna"
    assert rows[2025, "101"]["last_media_h"] == 925
    assert rows[2025, "102"]["spec_label"] == "Matematică (bilingv: Engleză)"
    assert rows[2025, "102"]["last_media_h"] is None and rows[2025, "102"]["occupied_seats"] == 20
    assert rows[2026, "101"]["spec_label"] == "Matematică (dual)"
    assert rows[2026, "101"]["source"] == URL.format(year=2026, county="SB")
    contracts.assert_clean(contracts.row_violations(archive.offers_of(parsed)), "offers")


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({"j": "BV"}, "j: "), ({"fi": "Seral"}, "fi: "), ({"n": "Postliceal"}, "n: "),
        ({"d": "POATE"}, "d: "), ({"f": "Alta"}, "f: "), ({"nlt": "2x"}, "nlt: "), ({"um": "abc"}, "um: not"),
        ({"um": "11"}, "um: not"), ({"l": " "}, "l: no text"), ({"sp": "absent"}, "sp: no text"),
        ({"um": ""}, "um: not"), ({"um": "absent"}, "um: key"),
    ],
)
def test_refused_records(spark, tmp_path, changes, reason):
    store(tmp_path, 2025, "SB", [record(**changes)])
    parsed = archive.parse_records(archive.read_snapshots(spark, str(tmp_path)))
    assert reason in parsed.first()["error"]
    with pytest.raises(contracts.ContractError, match=reason):
        contracts.assert_clean(archive.record_violations(parsed), "archive")


def test_archive_failures(spark, tmp_path):
    store(tmp_path, 2025, "SB", [record(), record()])
    parsed = archive.parse_records(archive.read_snapshots(spark, str(tmp_path)))
    assert [r["rule"] for r in archive.record_violations(parsed).collect()] == ["unique"]
    store(tmp_path, 2026, "SB", [record()], url=URL.format(year=2025, county="SB"))
    parsed = archive.parse_records(archive.read_snapshots(spark, str(tmp_path)))
    assert parsed.filter("year = 2026 and error like 'source_url%'").count() == 1
    (tmp_path / "2024-BV.json").write_text(json.dumps([record()]))
    with pytest.raises(ValueError, match="2024-BV"):
        archive.read_snapshots(spark, str(tmp_path))
    (tmp_path / "2024-BV.json.url").write_text(URL.format(year=2024, county="BV"))
    store(tmp_path, 2023, "CJ", [])
    with pytest.raises(ValueError, match="without records: 2023-CJ"):
        archive.read_snapshots(spark, str(tmp_path))
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "x.json").write_text("[]")
    with pytest.raises(ValueError, match="no snapshots"):
        archive.read_snapshots(spark, str(empty))


HEAD = "COD UNIC, COD SIIIR,MEDIU ,NOTA FINALA ROMANA,NOTA FINALA LB MATERNA,NOTA FINALA MATEMATICA,MEDIA,MEDIA V-VIII,ALTE\n"


def test_results(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(HEAD + "1,3261100001,urban,9.9,-,9.81,9.85,8.1300000000000008,x\n2,5161100001,RURAL,,7.5,6,,7,x\n")
    rows = exams.read_results(spark, str(path)).collect()
    assert rows[0].asDict() == {
        "school_code": "3261100001", "county": "SB", "urban": True, "romana_h": 990, "materna_h": None,
        "matematica_h": 981, "media_h": 985, "school_media_h": 813,
    }
    assert (rows[1]["county"], rows[1]["romana_h"], rows[1]["materna_h"]) == ("CL", None, 750)
    path.write_text(HEAD + "1,9961100001,urban,9.9,-,9.81,9.85,8,x\n")
    with pytest.raises(Exception, match="prefix"):
        exams.read_results(spark, str(path)).collect()
    assert "prefix" in exams.read_results(spark, str(path), strict=False).first()["error"]
    path.write_text(HEAD.replace("MEDIA V-VIII", "X") + "1,2,3,4,5,6,7,8,9\n")
    with pytest.raises(ValueError, match="MEDIA V-VIII"):
        exams.read_results(spark, str(path))
    path.write_text(HEAD)
    with pytest.raises(ValueError, match="no results"):
        exams.read_results(spark, str(path))


def test_samples_and_directory(spark, tmp_path):
    sample = tmp_path / "s.csv"
    sample.write_text("nota_finala_romana,nota_finala_limba_materna,nota_finala_matematica,media\n9.90,,9.81,9.85\n")
    row = exams.read_sample(spark, str(sample), EXAM_SAMPLE).first()
    assert str(row["media"]) == "9.85" and row["nota_finala_limba_materna"] is None
    listing = tmp_path / "d.csv"
    listing.write_text(
        "Lista,,,,\n,,,,\nCod SIIIR unitate,Denumire lunga unitate,Judet PJ,Localitate unitate,x\n"
        "1,Şcoala A,SB,SIBIU,x\n2,Scoala B,SB,MEDIAȘ,x\n3,Scoala C,CJ,SIBIU,x\n"
    )
    schools = exams.read_directory(spark, str(listing), "SB", "SIBIU")
    assert [tuple(r) for r in schools.collect()] == [("1", "Școala A")]
    results = spark.createDataFrame([("1", 5), ("9", 6)], "school_code string, x int")
    assert exams.restrict_to_schools(results, schools).count() == 1
    assert exams.observed_schools(schools, results.filter("x = 6")).isEmpty()


def published(spark, marks=(700, 710)):
    rows = [offer(2025, i, m) for i, m in enumerate(marks)] + [offer(2026, 1, 720, county="BV")]
    return cut_lineage(
        frame(spark, rows).withColumns({"provenance": F.lit("official"), "source": F.lit("https://x.ro/a")})
    )


def test_publication(spark, tmp_path):
    root = str(tmp_path / "out")
    assert sinks.current_generation(spark, root) is None
    first = published(spark)
    index = sinks.publish(first, root, "2026-01-01T00:00:00Z", "g1")
    assert index.count() == 2
    assert sinks.read_published(spark, root, county="SB").count() == 2
    plan = sinks.read_published(spark, root, county="SB")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(county" in plan
    back = sinks.read_published(spark, root).select(first.columns).withColumn("year", F.col("year").cast("int"))
    assert sets.snapshot_difference(back, first).isEmpty()
    sinks.publish(published(spark, (650,)), root, "2026-02-01T00:00:00Z", "g2")
    assert sinks.current_generation(spark, root) == "g2"
    assert sinks.read_published(spark, root).count() == 2
    assert [r["county"] for r in sinks.read_index(spark, root).collect()] == ["BV", "SB"]


def test_a_failed_publication_leaves_the_previous_one(spark, tmp_path):
    root = str(tmp_path / "out")
    good = published(spark)
    sinks.publish(good, root, "2026-01-01T00:00:00Z", "g1")
    with pytest.raises(contracts.ContractError, match="seats"):
        sinks.publish(good.withColumn("seats", F.lit(-1)), root, "2026-01-02T00:00:00Z", "g2")
    with pytest.raises(contracts.ContractError, match="differs from its dataset"):
        sinks.publish(good.withColumn("dataset_year", F.lit(2024)), root, "2026-01-02T00:00:00Z", "g2")
    with pytest.raises(contracts.ContractError, match="nothing"):
        sinks.publish(good.limit(0), root, "2026-01-02T00:00:00Z", "g2")
    broken = good.withColumn("last_media_h", F.when(F.col("spec_id") == "2025-1", F.raise_error(F.lit("lost"))).otherwise(700))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(broken, root, "2026-01-02T00:00:00Z", "g2")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.publish(good, root, "2026-01-02T00:00:00Z", "g1")
    assert sinks.current_generation(spark, root) == "g1"
    assert sinks.read_published(spark, root).count() == 3


def test_files_of_several_lines(spark, tmp_path):
    """Files are read whole, not line by line."""
    (tmp_path / "a.html").write_text("<p>a\n\nb</p>\n")
    (tmp_path / "a.html.url").write_text("https://h.ro/a\n\n")
    assert [tuple(r) for r in pages.read_fixture_pages(spark, str(tmp_path)).collect()] == [("a.html", "https://h.ro/a", "<p>a\n\nb</p>\n")]
    record = {"j": "AB", "c": "1"}
    (tmp_path / "2025-AB.json").write_text(json.dumps([record], indent=2) + "\n\n")
    (tmp_path / "2025-AB.json.url").write_text("https://x.ro/\n\n")
    row = archive.read_snapshots(spark, str(tmp_path)).collect()
    assert [(r["j"], r["c"], r["source_url"]) for r in row] == [("AB", "1", "https://x.ro/")]


def test_named_texts(spark, tmp_path):
    rows = [("a b.txt", "one"), ("c=d.txt", "two\nlines"), ("é.json", "")]
    sinks.write_named_texts(spark.createDataFrame(rows, "file string, text string"), str(tmp_path / "t"))
    found = {f.name: f.read_text() for f in (tmp_path / "t").iterdir() if not f.name.startswith(".")}
    assert found == {name: text + "\n" for name, text in rows}


def test_shortlist_faults(spark):
    row = {"year": 2025, "county": "AB", "schoolCode": "1", "schoolName": "s", "specId": "c", "specLabel": "l", "profile": "",
           "filiera": "teoretica", "limba": "ro", "seats": 5, "lastMedia": 7.05, "vocational": False}
    shot = {"schemaVersion": 1, "year": 2025, "county": "AB", "generatedAt": "t", "provenance": "official", "sources": [], "rows": [row]}
    saved = lambda **other: {"snapshots": [shot | {"rows": [row | other]}]}
    docs = {
        "good": [saved(), saved(lastMedia=None), saved(lastMedia=10, occupiedSeats=3)],
        "nothing": [],
        "kinds": [saved(), saved(seats="5", vocational=None), saved(lastMedia=7.055, year=2025.5)],
        "shape": [{"snapshots": {}}, 5, {"snapshots": [{"rows": 1}, shot | {"rows": []}]}],
        "many": [saved()] * 4,
        "object": {"snapshots": []},
    }
    raw = [(k, json.dumps(v)) for k, v in docs.items()] + [("broken", "[{"), ("null", None), ("empty", "")]
    raw = spark.createDataFrame(raw, "owner string, raw string")
    faults = shortlists.shortlist_faults(raw, "owner", max_saved=3)
    found = {}
    for r in faults.collect():
        found.setdefault(r["owner"], set()).add((r["path"], r["message"]))
    header = ("schemaVersion", "year", "county", "generatedAt", "provenance", "sources")
    assert found == {
        "kinds": {
            ("$[1].snapshots[0].rows[0].seats", "expected a whole number"),
            ("$[1].snapshots[0].rows[0].vocational", "missing"),
            ("$[2].snapshots[0].rows[0].lastMedia", "not a mark from 1 to 10 in hundredths"),
            ("$[2].snapshots[0].rows[0].year", "expected a whole number"),
        },
        "shape": {("$[0].snapshots", "expected an array"), ("$[1].snapshots", "missing"), ("$[2].snapshots[0].rows", "expected an array")}
        | {(f"$[2].snapshots[0].{name}", "missing") for name in header},
        "many": {("$", "more than 3 saved courses")},
        "object": {("$", "expected an array")},
        "broken": {("$", "not JSON")},
        "empty": {("$", "not JSON")},
    }
    sound = shortlists.sound_shortlists(raw, faults, "owner")
    assert {r["owner"] for r in sound.collect()} == {"good", "nothing", "null"}
    assert pages.read_shortlist(sound, owner="owner").count() == 3


def test_two_publishers(spark, tmp_path):
    root = str(tmp_path / "out")
    offers = published(spark)
    base = publication.last_number(spark, root)
    publication.publish(offers, root, "2026-01-01T00:00:00Z", "fast", base)
    with pytest.raises(publication.ConflictError):
        publication.publish(published(spark, (600,)), root, "2026-01-01T00:00:00Z", "slow", base)
    assert sinks.current_generation(spark, root) == "fast" and publication.stored_generations(spark, root) == ["fast"]
    # a pointer that was begun and never written is passed over, and its number is not used again
    (tmp_path / "out/log/000000000002.json").touch()
    assert sinks.current_generation(spark, root) == "fast"
    publication.publish(offers, root, "2026-01-02T00:00:00Z", "next")
    assert [tuple(r) for r in publication.versions(spark, root).select("version", "generation").orderBy("version").collect()] == [
        (1, "fast"), (3, "next")
    ]
    assert publication.read_published(spark, root, version=1).count() == 3
    with pytest.raises(ValueError, match="number 2"):
        publication.read_published(spark, root, version=2)


def test_expiry(spark, tmp_path):
    root = str(tmp_path / "out")
    for i in range(3):
        publication.publish(published(spark, (600 + i,)), root, "2026-01-01T00:00:00Z", f"g{i}")
    publication.write_generation(published(spark), root, "2026-01-01T00:00:00Z", "lost")
    assert publication.expire(spark, root, keep=2) == []  # the grace period is not over
    assert publication.expire(spark, root, keep=2, grace_seconds=-60) == ["g0", "lost"]
    assert publication.stored_generations(spark, root) == ["g1", "g2"]
    assert publication.expire(spark, root, keep=0, grace_seconds=-60) == ["g1"]
    assert publication.read_published(spark, root).agg(F.min("last_media_h")).first()[0] == 602
    with pytest.raises(contracts.ContractError, match="already exists"):
        publication.write_generation(published(spark), root, "2026-01-01T00:00:00Z", "g2")


def test_differences_by_digest(spark, tmp_path):
    root = str(tmp_path / "out")
    offers = published(spark)
    publication.publish(offers, root, "2026-01-01T00:00:00Z", "g1")
    assert publication.changed_datasets(offers.orderBy("spec_id"), root) == []
    assert publication.differences(offers, root).isEmpty()
    edited = offers.withColumn("limba", F.when(F.col("county") == "BV", F.lit(None)).otherwise(F.col("limba")))
    more = edited.unionByName(offers.filter("county = 'BV'").withColumn("county", F.lit("ZZ")))
    assert publication.changed_datasets(more, root) == [(2026, "BV"), (2026, "ZZ")]
    found = publication.differences(more, root).select("county", "limba", "only_in", "copies").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(
        map(str, [("BV", None, "source", 1), ("BV", offers.first()["limba"], "published", 1), ("ZZ", offers.first()["limba"], "source", 1)])
    )
    assert all("county=BV" in f for f in publication.read_datasets(spark, root, [(2026, "BV"), (2026, "ZZ")]).inputFiles())
    copies = offers.unionByName(offers.filter("county = 'SB'").limit(1))
    assert publication.changed_datasets(copies, root) == [(2025, "SB")]
    # a value that moves from one column to another one that was null
    rows = spark.createDataFrame([(1, "a", None)], "g int, x string, y string")
    moved = spark.createDataFrame([(1, None, "a")], "g int, x string, y string")
    both = [sets.digests(d, ["g"], ["x", "y"]) for d in (rows, moved)]
    assert sets.changed_groups(*both, ["g"]).count() == 1


def test_publication_reads_its_source_once(spark, tmp_path):
    source = str(tmp_path / "source")
    published(spark).write.parquet(source)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        reads.add(1)
        yield from batches

    offers = spark.read.parquet(source).coalesce(1)
    publication.publish(offers.mapInArrow(counted, offers.schema), str(tmp_path / "out"), "2026-01-01T00:00:00Z", "g1")
    assert reads.value == 1


def test_normalised_partitions_and_nesting(spark, tmp_path):
    offers = published(spark, tuple(range(600, 650)))
    sinks.write_normalized(offers, str(tmp_path / "n"))
    back = spark.read.parquet(str(tmp_path / "n")).withColumn("year", F.col("year").cast("int"))
    assert sets.snapshot_difference(back.select(offers.columns), offers).isEmpty()
    with pytest.raises(contracts.ContractError):
        sinks.write_normalized(offers.withColumn("track", F.lit("?")), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    nested = sinks.nest_datasets(offers, "2026-01-01T00:00:00Z", rows_per_part=10)
    assert nested.filter("county = 'SB'").count() == 5
    flat = sinks.flatten_datasets(nested)
    assert sets.snapshot_difference(flat.select(*[c for c in offers.columns if c not in ("provenance", "source")]),
                                    offers.drop("provenance", "source")).isEmpty()
    listed = {r["county"]: r["datasets"] for r in sinks.index_by_county(sinks.build_index(offers)).collect()}
    assert listed["SB"][0]["row_count"] == 50


def test_samples_reports_and_records(spark, tmp_path):
    rows = [(i, 100 + i * 37 % 901, 700 if i % 4 == 0 else None, 100 + i * 53 % 877, 600) for i in range(3000)]
    results = spark.createDataFrame(rows, "id int, romana_h bigint, materna_h bigint, matematica_h bigint, media_h bigint")
    sample = sinks.media_sample(results)
    assert {r["form"]: r["count"] for r in sample.groupBy("form").count().collect()} == sinks.MEDIA_SAMPLE
    headings = {"romana_h": "romana", "materna_h": "materna", "media_h": "media"}
    sinks.write_csv_sample(sample, str(tmp_path / "csv"), headings)
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0] == "romana,materna,media" and len(text) == 661 and text[1].split(",")[1] == ""
    knots = knots_2025(spark).withColumn("n", F.lit(9))
    sinks.write_calibration(knots, spark.createDataFrame([(9, 0.44)], "n int, rho double"), str(tmp_path / "k"))
    lines = [r["line"] for r in spark.read.parquet(str(tmp_path / "k/knots")).orderBy("school_media").collect()]
    assert lines[0] == "6.00 2.396 0.943 3.091 1.245 n=9"
    audit = spark.createDataFrame([(None, 3, 0.5, 0.1), ("SB", 3, 0.5, 0.1)], "county string, matched int, coverage double, mae double")
    report = json.loads(sinks.audit_report(audit).first()["report"])
    assert report["groups"] == 1 and report["reports"][0]["county"] == "SB" and report["coverage"] == 0.5
    path = str(tmp_path / "rec")
    record = lambda y, c, n: spark.createDataFrame([(y, c, n)], "year int, county string, n int")
    sinks.upsert_records(record(2024, "sb", 1).unionByName(record(2025, "sb", 2)), path)
    sinks.upsert_records(record(2024, "SB", 7), path)
    assert sorted((r["year"], r["n"]) for r in spark.read.parquet(path).collect()) == [(2024, 7), (2025, 2)]


def test_page_store(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>a</p>")
    (tmp_path / "a.html.url").write_text("https://h.ro/a\n")
    assert [tuple(r) for r in pages.read_fixture_pages(spark, str(tmp_path)).collect()] == [("a.html", "https://h.ro/a", "<p>a</p>")]
    (tmp_path / "b.html").write_text("<p>b</p>")
    with pytest.raises(ValueError, match="b.html"):
        pages.read_fixture_pages(spark, str(tmp_path))
    assert pages.read_manifest(spark, str(tmp_path / "none.jsonl")).isEmpty()
    manifest = tmp_path / "m.jsonl"
    manifest.write_text(json.dumps({"url": "https://h.ro/a", "file": "a.html"}) + "\n" + json.dumps({"url": "u", "file": "gone.html"}))
    stored = pages.stored_pages(pages.read_manifest(spark, str(manifest)), pages.read_bodies(spark, str(tmp_path)))
    assert [r["url"] for r in stored.collect()] == ["https://h.ro/a"]
