"""The published JSON contract: county files and saved shortlists, in the contract's own names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradecut.functions.marks import to_hundredths
from gradecut.schemas import CONTRACT_DATASET, CONTRACT_NAMES, CONTRACT_ROW, OFFER

_OPTIONAL = ("occupied_seats", "last_media")
_ROW = tuple(n for n in OFFER.fieldNames() if n != "last_media_h")
_HEADER = ("schema_version", "year", "county", "generated_at", "provenance", "sources", "rows")


def contract_name(own: str) -> str:
    """The contract's name of a field."""
    return CONTRACT_NAMES.get(own, own)


def _required(parsed: Column, names: tuple[str, ...], what: str) -> Column:
    """``parsed``, or an error that names the first required field without a value."""
    out = F.when(parsed.isNull(), F.raise_error(F.lit(f"{what} is null")))
    for name in names:
        if name not in _OPTIONAL:
            missing = F.raise_error(F.lit(f"{what} without {contract_name(name)}"))
            out = out.when(parsed[contract_name(name)].isNull(), missing)
    return out.otherwise(parsed)


def own_dataset(parsed: Column) -> Column:
    """A parsed document under this library's names, marks in exact hundredths.

    A required field that is absent or null fails, and so does a mark that is not a whole
    number of hundredths from 1 to 10.
    """
    sound = _required(parsed, _HEADER, "dataset")

    def row(r: Column) -> Column:
        held = _required(r, _ROW, "row")
        mark = held[contract_name("last_media")]
        exact = F.when(mark.isNotNull(), to_hundredths(mark, on_error="raise"))
        return F.struct(*[held[contract_name(n)].alias(n) for n in _ROW], exact.alias("last_media_h"))

    return F.struct(
        *[sound[contract_name(n)].alias(n) for n in _HEADER if n != "rows"], F.transform(sound["rows"], row).alias("rows")
    )


def parse_dataset(text: Column) -> Column:
    """A county document from its JSON text."""
    return own_dataset(F.from_json(text, CONTRACT_DATASET, {"mode": "FAILFAST"}))


def dataset_json(offers: DataFrame, headers: DataFrame) -> DataFrame:
    """year, county and the JSON document of every published dataset, its rows by school and course.

    The contract has one document for a dataset, so a dataset is one row here; for datasets
    larger than a row should be use ``sinks.nest_datasets``.
    """
    row = F.struct(
        *[F.col(n).alias(contract_name(n)) for n in _ROW], (F.col("last_media_h") / 100).alias(contract_name("last_media"))
    )
    order = F.struct("school_code", "spec_id", row.alias("row"))
    nested = offers.groupBy("year", "county").agg(F.array_sort(F.collect_list(order)).alias("_rows"))
    fields = [F.col(n).alias(contract_name(n)) for n in _HEADER if n != "rows"]
    document = F.struct(*fields, F.transform("_rows", lambda r: r["row"]).alias("rows"))
    return headers.join(nested, ["year", "county"]).select("year", "county", F.to_json(document).alias("document"))


def read_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """Offers of all county files (``*.json``) below a folder, with the dataset each was filed under."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(folder, wholetext=True)
    )
    parsed = files.select(parse_dataset(F.col("value")).alias("d"))
    return parsed.select(
        F.col("d.year").alias("dataset_year"),
        F.col("d.county").alias("dataset_county"),
        "d.provenance",
        "d.sources",
        "d.generated_at",
        F.explode("d.rows").alias("_row"),
    ).select("dataset_year", "dataset_county", "provenance", "sources", "generated_at", "_row.*")


__all__ = ["CONTRACT_ROW", "contract_name", "dataset_json", "own_dataset", "parse_dataset", "read_datasets"]
