"""Stored pages and saved shortlists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gradecut.operators.links import scope_pages
from gradecut.schemas import MANIFEST, PAGE, SAVED_COURSES
from gradecut.sources.contract import own_dataset


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows as JSON lines; a missing store is an empty one."""
    try:
        return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def stored_pages(
    manifest: DataFrame,
    bodies: DataFrame,
    records: DataFrame | None = None,
    year: int | None = None,
    county: str | None = None,
) -> DataFrame:
    """Pages of the manifest with their html; listed pages without a body are dropped.

    ``bodies`` has file and html. A year and county narrow the result to the pages
    recorded for them, or leave it whole when nothing is recorded.
    """
    listed = manifest
    if records is not None and year is not None and county is not None:
        listed = scope_pages(manifest, records, year, county)
    return listed.join(bodies, "file")


def read_bodies(spark: SparkSession, folder: str, suffix: str = ".html") -> DataFrame:
    """One row per stored file: its name and whole text."""
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("html"))


def read_fixture_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Committed pages with the address in each one's sidecar; a page without one fails."""
    bodies = read_bodies(spark, folder)
    sidecars = read_bodies(spark, folder, ".html.url").select(
        F.regexp_replace("file", r"\.url$", "").alias("file"), F.trim(F.regexp_replace("html", r"\s+", "")).alias("url")
    )
    known = sidecars.filter("url <> ''")
    lost = bodies.join(known, "file", "left_anti").select("file")
    total = lost.count()
    if total:
        some = ", ".join(r["file"] for r in lost.limit(20).collect())
        raise ValueError(f"{total} pages without a URL sidecar, among them {some}")
    return bodies.join(known, "file").select("file", *PAGE.fieldNames())


def read_shortlist(raw: DataFrame, column: str = "raw", owner: str | None = None) -> DataFrame:
    """Saved courses, one row per snapshot, from a JSON column; null means nothing saved.

    The text has the contract's names (``schoolCode``, ``lastMedia``). Check the result with
    ``contracts.saved_violations``. Text that is not an array of saved courses fails, as do
    documents without a required field and marks that are not whole hundredths.
    """
    keep = [owner] if owner else []
    listed = raw.filter(F.col(column).isNotNull())
    parsed = listed.withColumn(
        "_saved", F.from_json(column, SAVED_COURSES, {"mode": "FAILFAST"})
    ).withColumn("_id", F.monotonically_increasing_id() if not owner else F.col(owner))
    saved = parsed.select(*keep, "_id", F.posexplode("_saved").alias("_n", "_course")).select(
        *keep,
        F.concat_ws("-", F.col("_id").cast("string"), F.col("_n").cast("string")).alias("saved_id"),
        F.posexplode_outer("_course.snapshots").alias("place", "_snapshot"),
    )
    saved = saved.withColumn("_snapshot", F.when(F.col("_snapshot").isNotNull(), own_dataset(F.col("_snapshot"))))
    row = F.try_element_at("_snapshot.rows", F.lit(1))
    return saved.withColumn("_row", row).select(
        *keep,
        "saved_id",
        "place",
        F.size("_snapshot.rows").alias("row_total"),
        "_snapshot.provenance",
        "_snapshot.sources",
        "_snapshot.generated_at",
        *[F.col(f"_row.{n}").alias(n) for n in (
            "year", "county", "school_code", "school_name", "spec_id", "spec_label", "profile",
            "track", "limba", "seats", "occupied_seats", "last_media_h", "vocational",
        )],
    )
