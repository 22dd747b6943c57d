import json

import pytest
from pyspark.sql import functions as F

from gradecut.operators import contracts
from gradecut.operators.columns import OfferCols
from gradecut.schemas import OFFER
from gradecut.sources import contract, pages, sinks
from tests.test_cutoff import frame, offer


def rules(violations):
    return sorted((r["rule"], r["path"].split(".")[-1]) for r in violations.collect())


def changed(spark, **columns):
    df = frame(spark, [offer(2025, 1, 700)])
    return df.withColumns({name: F.lit(value).cast(df.schema[name].dataType) for name, value in columns.items()})


def test_good_rows_pass(spark):
    assert contracts.row_violations(frame(spark, [offer(2025, 1, 700), offer(2025, 2, None), offer(2025, 3, 700, occupied=99)])).isEmpty()


@pytest.mark.parametrize(
    "columns, broken",
    [
        ({"year": 1999}, [("year", "year")]),
        ({"county": "sb"}, [("county", "county")]),
        ({"school_code": ""}, [("text", "school_code")]),
        ({"spec_label": None}, [("text", "spec_label")]),
        ({"profile": ""}, []),
        ({"profile": None}, [("text", "profile")]),
        ({"limba": " ro"}, [("trimmed", "limba")]),
        ({"seats": -1}, [("seats", "seats")]),
        ({"occupied_seats": -1}, [("seats", "occupied_seats")]),
        ({"occupied_seats": None}, []),
        ({"track": "alta"}, [("track", "track")]),
        ({"vocational": True}, [("vocational", "vocational")]),
        ({"last_media_h": 99}, [("mark", "last_media_h")]),
        ({"year": 1999, "seats": -1, "county": "ABC"}, [("county", "county"), ("seats", "seats"), ("year", "year")]),
    ],
)
def test_row_rules(spark, columns, broken):
    assert rules(contracts.row_violations(changed(spark, **columns))) == broken


def test_all_violations_are_reported_together(spark):
    df = changed(spark, seats=-1).unionByName(changed(spark, track="alta"))
    with pytest.raises(contracts.ContractError) as error:
        contracts.assert_clean(contracts.row_violations(df), "offers")
    assert "seats" in str(error.value) and "track" in str(error.value)


def dataset(spark, rows=None, **header):
    rows = frame(spark, rows or [offer(2025, 1, 700)])
    values = {
        "schema_version": 1, "year": 2025, "county": "SB", "generated_at": "2026-01-01T00:00:00Z",
        "provenance": "official", "sources": ["https://x.ro"], **header,
    }
    heads = spark.createDataFrame(
        [tuple(values.values())],
        "schema_version int, year int, county string, generated_at string, provenance string, sources array<string>",
    )
    filed = rows.withColumns({"dataset_year": F.lit(values["year"]), "dataset_county": F.lit(values["county"])})
    return contracts.dataset_violations(heads, filed)


def test_dataset_rules(spark):
    assert dataset(spark).isEmpty()
    assert rules(dataset(spark, schema_version=2)) == [("version", "schema_version")]
    assert rules(dataset(spark, generated_at="soon")) == [("timestamp", "generated_at")]
    assert rules(dataset(spark, provenance="guess")) == [("provenance", "provenance")]
    assert rules(dataset(spark, provenance="synthetic")) == [("sources", "sources")]
    assert dataset(spark, provenance="synthetic", sources=[]).isEmpty()
    assert rules(dataset(spark, year=2026)) == [("year", "year")]
    assert [r["rule"] for r in dataset(spark, rows=[offer(2025, 1, 700), offer(2025, 1, 710)]).collect()] == ["unique"]


def test_index_rules_and_reconciliation(spark):
    offers = frame(spark, [offer(2025, 1, 700), offer(2025, 2, 700), offer(2026, 1, 700, county="BV")])
    index = sinks.build_index(offers)
    assert contracts.index_violations(index).isEmpty()
    assert [(r["year"], r["county"]) for r in index.collect()] == [(2026, "BV"), (2025, "SB")]
    assert contracts.reconcile_index(index, offers).isEmpty()
    wrong = index.withColumn("path", F.lit("x.json"))
    assert {r["rule"] for r in contracts.index_violations(wrong).collect()} == {"path"}
    assert {r["rule"] for r in contracts.index_violations(index.unionByName(index)).collect()} == {"unique"}
    found = contracts.reconcile_index(index, offers.filter("spec_id <> '2025-2' and year = 2025"))
    assert sorted((r["county"], r["rule"]) for r in found.collect()) == [("BV", "missing"), ("SB", "row_count")]
    other = contracts.reconcile_index(index, offers.withColumn("provenance", F.lit("synthetic")))
    assert {r["rule"] for r in other.collect()} == {"provenance"}


def saved_json(spark, courses, **changes):
    """A shortlist column: each course a list of (year, spec, label) snapshots."""
    snaps = []
    for c, snapshots in enumerate(courses):
        listed = []
        for year, spec, label, copies in snapshots:
            row = dict(
                year=year, county="SB", schoolCode="S1", schoolName="L", specId=spec, specLabel=label, profile="Real",
                filiera="teoretica", limba="ro", seats=28, occupiedSeats=28, lastMedia=7.05, vocational=False,
            )
            row.update(changes)
            row = {k: v for k, v in row.items() if v != "absent"}
            listed.append(dict(schemaVersion=1, year=year, county="SB", generatedAt="2026-01-01T00:00:00Z",
                               provenance="official", sources=["https://x.ro"], rows=[row] * copies))
        snaps.append({"snapshots": listed})
    return spark.createDataFrame([("u1", json.dumps(snaps)), ("u2", None)], "owner string, raw string")


def saved_rules(spark, courses, **kwargs):
    parsed = pages.read_shortlist(saved_json(spark, courses), owner="owner")
    return sorted(r["rule"] for r in contracts.saved_violations(parsed, OfferCols(), owner="owner", **kwargs).collect())


def test_saved_histories(spark):
    good = [(2026, "101", "Mate", 1), (2025, "99", "Mate", 1)]
    assert saved_rules(spark, [good]) == []
    assert saved_rules(spark, [good, good]) == ["unique"]
    assert saved_rules(spark, [good[::-1]]) == ["history"]
    assert saved_rules(spark, [[good[0], (2025, "99", "Filologie", 1)]]) == ["history"]
    assert saved_rules(spark, [[good[0], (2022, "99", "Mate", 1)]]) == ["history"]
    assert saved_rules(spark, [[(2026, "101", "Mate", 2)]]) == ["rows"]
    assert saved_rules(spark, [[good[0]], [(2026, "102", "Fizica", 1)]], max_saved=1) == ["cap"]


def test_text_that_is_no_shortlist_fails(spark):
    raw = spark.createDataFrame([("u", "broken")], "owner string, raw string")
    with pytest.raises(Exception):
        pages.read_shortlist(raw, owner="owner").collect()


def test_saved_rows_under_the_contracts_names(spark):
    course = [[(2026, "101", "Mate", 1)]]
    read = lambda **changes: pages.read_shortlist(saved_json(spark, course, **changes), owner="owner").first()
    row = read()
    assert (row["school_code"], row["track"], row["last_media_h"], row["generated_at"][:4]) == ("S1", "teoretica", 705, "2026")
    assert read(lastMedia=None)["last_media_h"] is None and read(occupiedSeats="absent")["occupied_seats"] is None
    for fault in ({"lastMedia": 9.855}, {"schoolCode": "absent"}, {"filiera": None}, {"lastMedia": 11}):
        with pytest.raises(Exception, match="grade|without"):
            read(**fault)


def test_county_files(spark, tmp_path):
    offers = frame(spark, [offer(2025, 1, 700), offer(2025, 2, None), offer(2026, 1, 855, county="BV")])
    headers = sinks.headers_of(offers.withColumns({"provenance": F.lit("official"), "source": F.lit("https://x.ro")}), "2026-01-01T00:00:00Z")
    for r in contract.dataset_json(offers, headers).collect():
        folder = tmp_path / str(r["year"])
        folder.mkdir(exist_ok=True)
        (folder / f"{r['county']}.json").write_text(r["document"])
    back = contract.read_datasets(spark, str(tmp_path))
    names = OFFER.fieldNames()
    assert sorted(map(tuple, back.select(*names).collect()), key=str) == sorted(map(tuple, offers.select(*names).collect()), key=str)
