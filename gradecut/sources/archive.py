"""Allocation archive: yearly county snapshots of all-text JSON records with URL sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradecut.functions.keys import course_label
from gradecut.functions.marks import media_cell_error, parse_media_cell
from gradecut.functions.text import normalize_text, track_of
from gradecut.schemas import OFFER, RAW_ALLOCATION

# File names of the snapshots, and the host that serves them.
_FILE = r"^(\d{4})-([A-Z]{1,2})\.json$"
SITE = "static.admitere.edu.ro"
_RECORDS = "array<map<string,string>>"


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records with year and county from the file name and the URL from its sidecar.

    Files of other names are skipped; a snapshot without records or without a sidecar, or no
    snapshot at all, is an error. ``um_given`` says whether a record has the cutoff's key: a null
    under it means that no cutoff was published, its absence that the record is incomplete.
    """
    files = (
        spark.read.option("pathGlobFilter", "*.json")
        .text(folder, wholetext=True)
        .select("value", F.col("_metadata.file_name").alias("file"))
        .filter(F.col("file").rlike(_FILE))
        .withColumn("_records", F.from_json("value", _RECORDS, {"mode": "FAILFAST"}))
        .drop("value")
    )
    _none_lost(files.filter(F.coalesce(F.size("_records"), F.lit(0)) <= 0).select("file"), "snapshots without records")
    record = F.col("_record")
    raw = files.select("file", F.explode("_records").alias("_record")).select(
        *[F.try_element_at(record, F.lit(n)).alias(n) for n in RAW_ALLOCATION.fieldNames()],
        F.map_contains_key(record, "um").alias("um_given"),
        "file",
        F.regexp_extract("file", _FILE, 1).cast("int").alias("year"),
        F.regexp_extract("file", _FILE, 2).alias("county"),
    )
    sidecars = (
        spark.read.option("pathGlobFilter", "*.json.url")
        .text(folder, wholetext=True)
        .select(
            F.regexp_replace(F.col("_metadata.file_name"), r"\.url$", "").alias("file"),
            F.trim(F.regexp_replace("value", r"\s+", "")).alias("source_url"),
        )
    )
    if raw.isEmpty():
        raise ValueError(f"no snapshots in {folder}")
    _none_lost(files.select("file").join(sidecars, "file", "left_anti"), "snapshots without a URL sidecar")
    return raw.join(sidecars, "file")


def _none_lost(files: DataFrame, what: str) -> None:
    """Fail if there are any such files; the archive has one for each year and county."""
    lost = sorted(r["file"] for r in files.collect())
    if lost:
        raise ValueError(f"{len(lost)} {what}: " + ", ".join(lost))


def _count(text: Column) -> Column:
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int"))


def parse_records(raw: DataFrame, site: str = SITE) -> DataFrame:
    """Typed offer columns plus ``error``, the first reason a record is refused, or null."""
    names = ("j", "c", "l", "lc", "sp", "lp", "lb", "nlt", "nlo", "fi", "p", "f", "n", "d", "um")
    text = raw.withColumns({f"_{n}": normalize_text(F.col(n)) for n in names})
    c = F.col
    url = F.concat(
        F.lit(f"{site}/"), c("year").cast("string"), F.lit("/repartizare/"), c("county"),
        F.lit("/data/specialization.json"),
    )
    required = ("j", "c", "l", "lc", "sp", "lp", "lb", "nlt", "nlo", "fi", "p", "f")
    cell = F.coalesce(c("um"), F.lit("-"))
    dual = F.coalesce(c("_d"), F.lit("NU"))
    given = c("um_given") if "um_given" in raw.columns else F.lit(True)
    error = F.when(
        ~F.regexp_replace("source_url", r"^https?://|[?#].*$", "").eqNullSafe(url),
        "source_url: belongs to another snapshot",
    )
    for name in required:
        error = error.when(c(f"_{name}").isNull() | (c(f"_{name}") == ""), f"{name}: no text")
    error = (
        error.when(c("_j") != c("county"), "j: not the county of the file")
        .when(c("_fi") != "Zi", "fi: only day classes are read")
        .when(c("n").isNotNull() & (c("_n") != "Liceal"), "n: only upper secondary is read")
        .when(~dual.isin("DA", "NU"), "d: neither DA nor NU")
        .when(track_of(c("_f")).isNull(), "f: no such track")
        .when(_count(c("_nlt")).isNull(), "nlt: not a count")
        .when(_count(c("_nlo")).isNull(), "nlo: not a count")
        .when(~given, "um: key is absent")
        .when((c("_um") == "") | media_cell_error(cell).isNotNull(), "um: not a mark")
    )
    track = track_of(c("_f"))
    return text.select(
        "file",
        "source_url",
        "year",
        "county",
        c("_lc").alias("school_code"),
        c("_l").alias("school_name"),
        c("_c").alias("spec_id"),
        course_label(c("_sp"), c("_lb"), dual == "DA").alias("spec_label"),
        c("_p").alias("profile"),
        track.alias("track"),
        c("_lp").alias("limba"),
        _count(c("_nlt")).alias("seats"),
        _count(c("_nlo")).alias("occupied_seats"),
        parse_media_cell(cell, on_error="null").alias("last_media_h"),
        (track == "vocationala").alias("vocational"),
        error.alias("error"),
    )


def record_violations(parsed: DataFrame) -> DataFrame:
    """Refused records, and courses that occur twice in one file."""
    where = F.concat_ws("/", "school_code", "spec_id")
    refused = parsed.filter("error is not null").select(
        F.col("file").alias("dataset"),
        where.alias("path"),
        F.lit("record").alias("rule"),
        F.col("error").alias("message"),
    )
    counts = parsed.groupBy("file", "school_code", "spec_id").agg(F.count(F.lit(1)).alias("_n"))
    twice = counts.filter("_n > 1").select(
        F.col("file").alias("dataset"),
        where.alias("path"),
        F.lit("unique").alias("rule"),
        F.lit("the course is listed again").alias("message"),
    )
    return refused.unionByName(twice)


def offers_of(parsed: DataFrame, provenance: str = "official") -> DataFrame:
    """Accepted records as offers, with where they came from."""
    return parsed.filter("error is null").select(
        *OFFER.fieldNames(), F.lit(provenance).alias("provenance"), F.col("source_url").alias("source")
    )
