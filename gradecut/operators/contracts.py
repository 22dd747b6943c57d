"""Contract checks: each returns a violations DataFrame, empty when the data is good."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.functions import keys
from gradecut.functions.marks import ANY_SPACE
from gradecut.functions.text import matches_search
from gradecut.operators.columns import OfferCols
from gradecut.operators.matching import course_history
from gradecut.params import (
    COUNTY_PATTERN,
    EPOCH_YEAR,
    MARK_MAX_H,
    MARK_MIN_H,
    MAX_SAVED,
    MAX_YEAR,
    MIN_YEAR,
    PROVENANCES,
    SCHEMA_VERSION,
    TRACKS,
)
from gradecut.session import shared_path

PADDED = f"^{ANY_SPACE}|{ANY_SPACE}\\z"

# (rule, column, condition that holds when the rule is broken, message)
Rule = tuple[str, str, Column, str]


class ContractError(ValueError):
    """Data broke a contract; the message lists what and where."""


def assert_clean(violations: DataFrame, what: str, shown: int = 100) -> None:
    """Fail if there is any violation. The message shows the first ones; when there are more,
    all of them are in a table that it names."""
    found = violations.limit(shown + 1).collect()
    if not found:
        return
    lines = [f"  {row['dataset']} {row['path']}: {row['message']}" for row in found[:shown]]
    if len(found) > shown:
        path = shared_path(violations.sparkSession, "violations")
        violations.write.parquet(path)
        total = violations.sparkSession.read.parquet(path).count()
        lines.append(f"  ... all {total} violations are in {path}")
    raise ContractError(f"{what} broke its contract:\n" + "\n".join(lines))


def _broken(df: DataFrame, dataset: Column, where: Column, rules: list[Rule]) -> DataFrame:
    """One output row per broken rule, from one pass over ``df``."""
    marks = [
        F.when(
            F.coalesce(broken, F.lit(False)),
            F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.lit(text).alias("message")),
        )
        for rule, column, broken, text in rules
    ]
    failed = df.select(
        dataset.alias("dataset"), where.alias("_where"), F.array_compact(F.array(*marks)).alias("_failed")
    ).filter(F.size("_failed") > 0)
    return failed.select("dataset", "_where", F.explode("_failed").alias("_f")).select(
        "dataset",
        F.concat_ws(".", "_where", "_f.column").alias("path"),
        "_f.rule",
        "_f.message",
    )


def offer_rules() -> list[Rule]:
    c = F.col
    blank = lambda name: c(name).isNull() | (c(name) == "")
    rules: list[Rule] = [
        ("year", "year", c("year").isNull() | ~c("year").between(MIN_YEAR, MAX_YEAR), "outside 2000..2100"),
        ("county", "county", c("county").isNull() | ~c("county").rlike(COUNTY_PATTERN), "not a county code"),
    ]
    for name in ("school_code", "school_name", "spec_id", "spec_label"):
        rules.append(("text", name, blank(name), "expected non-empty text"))
    for name in ("profile", "limba"):
        rules.append(("text", name, c(name).isNull(), "expected text"))
    for name in ("school_name", "spec_label", "profile", "limba"):
        rules.append(("trimmed", name, c(name).rlike(PADDED), "white space at an end"))
    mark = c("last_media_h")
    rules += [
        ("seats", "seats", c("seats").isNull() | (c("seats") < 0), "expected a count"),
        ("seats", "occupied_seats", c("occupied_seats") < 0, "expected a count"),
        ("track", "track", c("track").isNull() | ~c("track").isin(*TRACKS), "unknown track"),
        ("vocational", "vocational", c("vocational").isNull(), "expected true or false"),
        (
            "vocational",
            "vocational",
            c("track").isin(*TRACKS) & (c("vocational") != (c("track") == "vocationala")),
            "does not follow from the track",
        ),
        ("mark", "last_media_h", ~mark.between(MARK_MIN_H, MARK_MAX_H), "outside 1..10"),
    ]
    return rules


def row_violations(offers: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Row contract of flat offers."""
    dataset = F.concat_ws("/", F.col("year").cast("string"), "county")
    where = keys.spec_key(F.col("school_code"), F.col("spec_id"))
    return _broken(offers, dataset, where, rules or offer_rules())


def duplicate_violations(offers: DataFrame, dataset: Column, key: list[str]) -> DataFrame:
    """Keys that occur more than once in a dataset; copies are combined before the shuffle."""
    counts = offers.groupBy(dataset.alias("dataset"), *key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter("_n > 1").select(
        "dataset",
        F.concat_ws("/", *key).alias("path"),
        F.lit("unique").alias("rule"),
        F.concat(F.lit("occurs "), F.col("_n").cast("string"), F.lit(" times")).alias("message"),
    )


def header_violations(datasets: DataFrame) -> DataFrame:
    """Headers of published datasets, one row each."""
    c = F.col
    blank_source = F.exists("sources", lambda s: s.isNull() | (s == ""))
    headers: list[Rule] = [
        ("version", "schema_version", ~c("schema_version").eqNullSafe(SCHEMA_VERSION), "unknown version"),
        ("year", "year", c("year").isNull() | ~c("year").between(MIN_YEAR, MAX_YEAR), "outside 2000..2100"),
        ("county", "county", c("county").isNull() | ~c("county").rlike(COUNTY_PATTERN), "not a county code"),
        ("timestamp", "generated_at", F.try_to_timestamp("generated_at").isNull(), "not a timestamp"),
        ("provenance", "provenance", c("provenance").isNull() | ~c("provenance").isin(*PROVENANCES), "unknown"),
        ("sources", "sources", c("sources").isNull() | blank_source, "expected an array of text"),
        (
            "sources",
            "sources",
            (c("provenance") == "synthetic") & (F.size("sources") > 0),
            "made-up data cannot have sources",
        ),
    ]
    return _broken(datasets, F.concat_ws("/", c("year").cast("string"), "county"), F.lit("$"), headers)


def filing_rules() -> list[Rule]:
    """That a row lies in the dataset it belongs to."""
    c = F.col
    return [
        ("year", "year", ~c("year").eqNullSafe(c("dataset_year")), "differs from its dataset"),
        ("county", "county", ~c("county").eqNullSafe(c("dataset_county")), "differs from its dataset"),
    ]


def dataset_violations(datasets: DataFrame, offers: DataFrame) -> DataFrame:
    """Headers and rows of published datasets.

    ``datasets`` holds one header per dataset; ``offers`` carries the ``dataset_year`` and
    ``dataset_county`` each row was filed under.
    """
    filed = F.concat_ws("/", F.col("dataset_year").cast("string"), "dataset_county")
    where = keys.spec_key(F.col("school_code"), F.col("spec_id"))
    return (
        header_violations(datasets)
        .unionByName(_broken(offers, filed, where, offer_rules() + filing_rules()))
        .unionByName(duplicate_violations(offers, filed, ["school_code", "spec_id"]))
    )


def index_violations(index: DataFrame) -> DataFrame:
    """Index entries: path follows from year and county, counts and provenance are sound."""
    c = F.col
    expected = F.concat(c("year").cast("string"), F.lit("/"), c("county"), F.lit(".json"))
    rules: list[Rule] = [
        ("year", "year", c("year").isNull() | ~c("year").between(MIN_YEAR, MAX_YEAR), "outside 2000..2100"),
        ("county", "county", c("county").isNull() | ~c("county").rlike(COUNTY_PATTERN), "not a county code"),
        ("path", "path", ~c("path").eqNullSafe(expected), "does not follow from year and county"),
        ("count", "row_count", c("row_count").isNull() | (c("row_count") < 0), "expected a count"),
        ("provenance", "provenance", c("provenance").isNull() | ~c("provenance").isin(*PROVENANCES), "unknown"),
    ]
    return _broken(index, expected, F.lit("$.datasets"), rules).unionByName(
        duplicate_violations(index, expected, ["year", "county"])
    )


def reconcile_index(index: DataFrame, offers: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """Index against data: one row per dataset that is missing, unlisted or of another size.

    ``offers`` may carry ``provenance``; it is then compared as well.
    """
    key = [cols.year, *cols.group]
    measures = [F.count(F.lit(1)).alias("found_rows")]
    compares = "provenance" in offers.columns and "provenance" in index.columns
    if compares:
        measures += [F.min("provenance").alias("_least"), F.max("provenance").alias("_most")]
    found = offers.groupBy(*key).agg(*measures)
    listed = index.select(*key, F.col("row_count").alias("listed_rows"), *(["provenance"] if compares else []))
    both = listed.join(found, key, "full_outer")
    rule = (
        F.when(F.col("listed_rows").isNull(), "unlisted")
        .when(F.col("found_rows").isNull(), "missing")
        .when(F.col("listed_rows") != F.col("found_rows"), "row_count")
    )
    if compares:
        same = F.col("_least").eqNullSafe(F.col("provenance")) & F.col("_most").eqNullSafe(F.col("provenance"))
        rule = rule.when(~same, "provenance")
    return both.withColumn("rule", rule).filter("rule is not null").select(
        *key, "rule", "listed_rows", "found_rows"
    )


def history_violations(
    offers: DataFrame,
    target_year: int,
    cols: OfferCols = OfferCols(),
    epoch_year: int = EPOCH_YEAR,
    dataset: str | None = None,
) -> DataFrame:
    """Why a group's history cannot be fitted for ``target_year``.

    With ``dataset`` naming the file or delivery a row came from, a year delivered twice
    is reported too.
    """
    if isinstance(target_year, bool) or not isinstance(target_year, int):
        raise ContractError("target_year must be an integer")
    per_year = offers.groupBy(*cols.group, F.col(cols.year).alias("year")).agg(
        *([F.min(dataset).alias("_d0"), F.max(dataset).alias("_d1")] if dataset else [F.lit(0).alias("_d0")])
    )
    other_epoch = ~keys.comparable_years(F.col("year"), F.lit(target_year), epoch_year)
    rules: list[Rule] = [
        ("epoch", "year", other_epoch, f"not comparable with {target_year}"),
        ("target", "year", F.col("year") >= target_year, f"target {target_year} is not after it"),
    ]
    if dataset:
        rules.append(("duplicate", "year", F.col("_d0") != F.col("_d1"), "delivered twice"))
    return _broken(per_year, F.concat_ws("/", *cols.group), F.col("year").cast("string"), rules)


def assert_history(offers: DataFrame, target_year: int, cols: OfferCols = OfferCols(), **kwargs) -> None:
    """Fail if there is no history, or one that cannot be fitted."""
    if offers.isEmpty():
        raise ContractError("there is no history to fit")
    assert_clean(history_violations(offers, target_year, cols, **kwargs), "cutoff history")


def saved_violations(
    snapshots: DataFrame,
    cols: OfferCols = OfferCols(),
    epoch_year: int = EPOCH_YEAR,
    max_saved: int = MAX_SAVED,
    owner: str | None = None,
) -> DataFrame:
    """Saved histories, one row per saved course and snapshot place.

    ``snapshots`` has ``saved_id``, ``place`` (0 for the newest), ``row_total`` (rows in
    that snapshot) and the offer columns of its row. Each history must be what
    ``course_history`` would select from it: one row per snapshot, distinct years newest
    first, one course, comparable years; first courses are unique and capped per owner.
    """
    scope = [owner] if owner else []
    first = snapshots.filter("place = 0")
    ident = lambda: F.concat_ws("/", *cols.group, F.col(cols.year).cast("string"), *cols.key)
    per_saved = snapshots.groupBy(*scope, "saved_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.countDistinct(cols.year).alias("_years"),
        F.max("row_total").alias("_most"),
        F.min("row_total").alias("_least"),
    )
    # Grouped by saved course as well, so a history is matched against its own snapshots only.
    own_cols = replace(cols, group=("saved_id", *cols.group))
    own = snapshots.drop("place", "row_total")
    expected = course_history(
        first.withColumn("_sid", F.col("saved_id")), own, own_cols, saved_id="_sid", epoch_year=epoch_year
    )
    place = snapshots.select("saved_id", "place", *cols.group, cols.year, *cols.key)
    selected = (
        expected.join(place, ["saved_id", *cols.group, cols.year, *cols.key])
        .groupBy("saved_id")
        .agg(
            F.count(F.lit(1)).alias("_selected"),
            F.count_if(F.col("place") != F.col("history_rank")).alias("_moved"),
        )
    )
    checked = per_saved.join(selected, "saved_id", "left")
    off = (
        (F.coalesce("_selected", F.lit(0)) != F.col("_n"))
        | (F.col("_moved") > 0)
        | (F.col("_years") != F.col("_n"))
    )
    rules: list[Rule] = [
        ("rows", "snapshots", (F.col("_most") != 1) | (F.col("_least") != 1), "a snapshot must hold one row"),
        ("history", "snapshots", off, "not the history of one course"),
    ]
    where = F.col("saved_id").cast("string")
    broken = _broken(checked, F.lit("saved"), where, rules)
    repeats = first.groupBy(*scope, ident().alias("_course")).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_saved.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    message = lambda text: [F.lit(text).alias("message")]
    return broken.unionByName(
        repeats.filter("_n > 1").select(
            F.lit("saved").alias("dataset"),
            F.col("_course").alias("path"),
            F.lit("unique").alias("rule"),
            *message("course saved twice"),
        )
    ).unionByName(
        totals.filter(F.col("_n") > max_saved).select(
            F.lit("saved").alias("dataset"),
            F.concat_ws("/", *scope).alias("path") if scope else F.lit("$").alias("path"),
            F.lit("cap").alias("rule"),
            *message(f"more than {max_saved} saved courses"),
        )
    )


def text_filter(offers: DataFrame, needle: str, track: str | None, text: list[str]) -> DataFrame:
    """Offers of a track whose joined text contains ``needle``, accents and case ignored."""
    kept = offers if track is None else offers.filter(F.col("track") == track)
    return kept.filter(matches_search(F.concat_ws(" ", *text), needle))
