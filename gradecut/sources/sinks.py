"""Writers: normalised partitions, published generations, samples, tables and records."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradecut.functions.marks import format_media_h
from gradecut.operators.calibration import format_knots
from gradecut.operators.columns import OfferCols
from gradecut.operators.contracts import assert_clean, dataset_violations
from gradecut.operators.ranking import even_sample
from gradecut.params import SCHEMA_VERSION
from gradecut.schemas import NESTED_ROW
from gradecut.session import cut_lineage, remove_folder, shared_path
from gradecut.sources.publication import ROW_ORDER as _ROW_ORDER
from gradecut.sources.publication import current_generation, headers_of, publish, read_index, read_published

__all__ = [
    "build_index", "current_generation", "headers_of", "publish", "read_index", "read_published", "write_normalized",
]


def write_normalized(offers: DataFrame, path: str, checked: bool = True) -> None:
    """Offers partitioned by year and county in a fixed order, nothing before all are valid.

    Rows are ranged on their whole order, so a county holding a third of them is written
    by many tasks.
    """
    if checked:
        filed = offers.withColumns(
            {"dataset_year": F.col("year"), "dataset_county": F.col("county")}
        )
        assert_clean(dataset_violations(headers_of(offers, "1970-01-01T00:00:00Z"), filed), "offers")
    (
        offers.repartitionByRange(*_ROW_ORDER)
        .sortWithinPartitions(*_ROW_ORDER)
        .write.mode("overwrite")
        .partitionBy("year", "county")
        .parquet(path)
    )


def build_index(offers: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """One entry per year and county, newest year first, then by county."""
    county = cols.group[0]
    provenance = F.max("provenance") if "provenance" in offers.columns else F.lit("official")
    entries = offers.groupBy(F.col(cols.year).alias("year"), F.col(county).alias("county")).agg(
        F.count(F.lit(1)).alias("row_count"), provenance.alias("provenance")
    )
    path = F.concat(F.col("year").cast("string"), F.lit("/"), F.col("county"), F.lit(".json"))
    return entries.select("year", "county", path.alias("path"), "row_count", "provenance").orderBy(
        F.col("year").desc(), "county"
    )


def nest_datasets(offers: DataFrame, generated_at: str, rows_per_part: int = 5000) -> DataFrame:
    """Nested documents of at most about ``rows_per_part`` rows, whole datasets in parts.

    The reader's documents hold rows as an array. A dataset larger than one array should
    hold is split into numbered parts by a hash of the course, so no task builds one huge
    array and no row is lost.
    """
    sizes = headers_of(offers, generated_at).join(
        offers.groupBy("year", "county").agg(F.count(F.lit(1)).alias("_n")), ["year", "county"]
    )
    parts = F.ceil(F.col("_n") / rows_per_part).cast("int")
    row = F.struct(
        *[
            (F.col("last_media_h") / 100).cast("decimal(4,2)").alias(n)
            if n == "last_media"
            else F.col(n).alias(n)
            for n in NESTED_ROW.fieldNames()
        ]
    )
    counts = sizes.select("year", "county", parts.alias("_parts"))
    placed = offers.join(counts, ["year", "county"]).select(
        "year",
        "county",
        F.pmod(F.xxhash64("school_code", "spec_id"), F.col("_parts")).cast("int").alias("part"),
        row.alias("_row"),
    )
    rows = F.array_sort(
        F.collect_list("_row"),
        lambda a, b: F.when(
            (a["school_code"] < b["school_code"])
            | ((a["school_code"] == b["school_code"]) & (a["spec_id"] < b["spec_id"])),
            -1,
        )
        .when((a["school_code"] == b["school_code"]) & (a["spec_id"] == b["spec_id"]), 0)
        .otherwise(1),
    )
    nested = placed.groupBy("year", "county", "part").agg(rows.alias("rows"))
    return nested.join(sizes.drop("_n"), ["year", "county"])


def flatten_datasets(nested: DataFrame) -> DataFrame:
    """Nested documents back to flat offers, each with the dataset it was filed under."""
    rows = nested.select(
        F.col("year").alias("dataset_year"),
        F.col("county").alias("dataset_county"),
        "provenance",
        "sources",
        "generated_at",
        F.explode("rows").alias("_row"),
    )
    fields = [n for n in NESTED_ROW.fieldNames() if n != "last_media"]
    return rows.select(
        "dataset_year",
        "dataset_county",
        "provenance",
        "sources",
        "generated_at",
        *[F.col(f"_row.{n}").alias(n) for n in fields],
        (F.col("_row.last_media") * 100).cast("bigint").alias("last_media_h"),
    )


def index_by_county(index: DataFrame) -> DataFrame:
    """County to its entries, newest first: at most one entry per admissible year."""
    entry = F.struct((-F.col("year")).alias("_newest"), "year", "path", "row_count")
    return index.groupBy("county").agg(F.array_sort(F.collect_list(entry)).alias("_e")).select(
        "county",
        F.transform("_e", lambda e: F.struct(e["year"], e["path"], e["row_count"])).alias("datasets"),
    )


def paper_form(results: DataFrame) -> Column:
    """Stratum of an exam result: two or three papers, with or without a truncated average."""
    two = F.col("romana_h") + F.col("matematica_h")
    three = two + F.col("materna_h")
    return (
        F.when(F.col("romana_h").isNull() | F.col("matematica_h").isNull() | F.col("media_h").isNull(), None)
        .when(F.col("materna_h").isNull(), F.when(two % 2 == 0, "two_exact").otherwise("two_truncating"))
        .otherwise(F.when(three % 3 == 0, "three_exact").otherwise("three_truncating"))
    )


# How many rows of each stratum the media sample takes.
MEDIA_SAMPLE = {"two_truncating": 220, "two_exact": 110, "three_truncating": 220, "three_exact": 110}


def media_sample(results: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """Evenly spaced, deterministic sample of each stratum; marks only, no identifiers."""
    marks = ["romana_h", "materna_h", "matematica_h"]
    formed = results.withColumn("form", paper_form(results)).filter("form is not null")
    # One row per combination of marks, with the highest published average among copies.
    distinct = formed.groupBy("form", *marks).agg(F.max("media_h").alias("media_h"))
    counts = counts or MEDIA_SAMPLE
    wanted = F.create_map(*[F.lit(v) for pair in counts.items() for v in pair])
    count = F.try_element_at(wanted, F.col("form"))
    # One row per combination by now, so nothing is left to fold; written once, as it is read twice.
    folded = cut_lineage(distinct.filter(F.col("form").isin(*counts)))
    return even_sample(folded, ["form"], marks, count, unique=True)


def write_named_texts(files: DataFrame, path: str) -> None:
    """Each row of ``files`` (file, text) as a file of its own name in one folder, ended by a line end.

    Executors write the texts; the driver then gives the files their names, one rename each.
    """
    spark = files.sparkSession
    staged = shared_path(spark, "texts")
    named = files.select(F.col("file").alias("file"), F.col("text")).repartition("file")
    named.write.partitionBy("file").text(staged)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(path))
    for part in system.globStatus(hadoop.Path(f"{staged}/file=*/part-*")):
        name = unquote(part.getPath().getParent().getName().removeprefix("file="))
        if not system.rename(part.getPath(), hadoop.Path(f"{path}/{name}")):
            raise ValueError(f"{name} is there twice")
    remove_folder(spark, staged)


def write_csv_sample(sample: DataFrame, path: str, headings: dict[str, str]) -> None:
    """A sample of fixed size as one CSV with two-decimal marks; null marks stay empty."""
    columns = [format_media_h(F.col(ours)).alias(theirs) for ours, theirs in headings.items()]
    order = [F.col(ours) for ours in headings]
    ordered = sample.orderBy(*order).select(*columns)
    ordered.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_calibration(knots: DataFrame, rho: DataFrame, path: str) -> None:
    """Knot table with its text form, and the residual correlation beside it."""
    format_knots(knots).coalesce(1).write.mode("overwrite").parquet(f"{path}/knots")
    rho.coalesce(1).write.mode("overwrite").parquet(f"{path}/rho")


def write_effects(effects: DataFrame, path: str) -> None:
    effects.write.mode("overwrite").parquet(path)


def audit_report(audit: DataFrame, cols: OfferCols = OfferCols()) -> DataFrame:
    """The audit as one JSON document: totals, and one entry per group."""
    group = list(cols.group)
    total = F.col(group[0]).isNull()
    entry = F.struct(*[F.col(c) for c in audit.columns])
    document = audit.agg(
        F.max(F.when(total, F.col("matched"))).alias("matched"),
        F.max(F.when(total, F.col("coverage"))).alias("coverage"),
        F.max(F.when(total, F.col("mae"))).alias("mean_absolute_error"),
        F.count_if(~total).alias("groups"),
        F.array_sort(F.collect_list(F.when(~total, entry))).alias("reports"),
    )
    return document.select(F.to_json(F.struct(*document.columns)).alias("report"))


def upsert_records(records: DataFrame, path: str) -> None:
    """Replace the records of exactly the years and counties given; others stay."""
    (
        records.withColumn("county", F.upper("county"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "county")
        .parquet(path)
    )

