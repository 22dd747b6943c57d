"""Exam results, numeric samples and school directories from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradecut.functions.keys import county_of_school
from gradecut.functions.marks import sheet_cells
from gradecut.functions.text import fix_diacritics

# Result column and the published heading it is read from.
RESULT_HEADINGS = {
    "school_code": "COD SIIIR",
    "setting": "MEDIU",
    "romana_h": "NOTA FINALA ROMANA",
    "materna_h": "NOTA FINALA LB MATERNA",
    "matematica_h": "NOTA FINALA MATEMATICA",
    "media_h": "MEDIA",
    "school_media_h": "MEDIA V-VIII",
}
GRADES = ("romana_h", "materna_h", "matematica_h", "media_h", "school_media_h")
# Headings of the school directory.
DIRECTORY = {
    "code": "Cod SIIIR unitate",
    "name": "Denumire lunga unitate",
    "county": "Judet PJ",
    "locality": "Localitate unitate",
}


def locate_columns(columns: list[str], headings: dict[str, str] | None = None) -> dict[str, str]:
    """Our name to the file's own heading, ignoring case and outer spaces."""
    headings = headings or RESULT_HEADINGS
    seen = {name.strip().upper(): name for name in reversed(columns)}
    missing = [label for label in headings.values() if label.upper() not in seen]
    if missing:
        raise ValueError(f"no column {missing}; the header was: {' | '.join(seen)}")
    return {ours: seen[label.upper()] for ours, label in headings.items()}


def read_results(spark: SparkSession, path: str, strict: bool = True, **options: str) -> DataFrame:
    """Exam results with marks in hundredths; the other published columns are never read.

    ``strict`` fails the job on an unknown school prefix or an unreadable grade; otherwise
    those rows carry an ``error``.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").options(**options).csv(path)
    located = locate_columns(raw.columns)
    if raw.isEmpty():
        raise ValueError(f"{path} holds no results")
    text = raw.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in located.items()])
    return results_of(text, strict)


def results_of(text: DataFrame, strict: bool = True) -> DataFrame:
    """All-text result columns to typed ones."""
    # The cells are read once, in one array: a column for each step makes more generated code than the JVM compiles.
    text = text.withColumns({"_cells": sheet_cells(*GRADES), "_code": F.trim("school_code")})
    text = text.withColumn("_county", county_of_school(F.col("_code")))
    cell = {name: F.get("_cells", F.lit(i)) for i, name in enumerate(GRADES)}
    code, county = F.col("_code"), F.col("_county")
    unknown_county = F.when(county.isNull(), F.concat(F.lit("unknown county prefix: "), code))
    error = F.coalesce(unknown_county, *[F.concat(F.lit(f"{name}: "), cell[name]["error"]) for name in GRADES])
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown county prefix: "), code)).cast("string")
        county = F.when(county.isNull(), unknown).otherwise(county)
    refuse = lambda c: F.when(c["error"].isNotNull(), F.raise_error(c["error"]).cast("bigint")).otherwise(c["mark_h"])
    columns = [
        code.alias("school_code"),
        county.alias("county"),
        (F.upper(F.trim("setting")) == "URBAN").alias("urban"),
        *[(refuse(cell[name]) if strict else cell[name]["mark_h"]).alias(name) for name in GRADES],
    ]
    if not strict:
        columns.append(error.alias("error"))
    return text.select(*columns)


def read_sample(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A numeric sample; empty cells are null, anything else that is not a number fails."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_directory(
    spark: SparkSession, path: str, county: str, locality: str, **options: str
) -> DataFrame:
    """Schools of one locality from a directory whose header follows a preamble.

    The locality is compared, not only the county, and the filter drops the preamble too.
    """
    raw = spark.read.options(**options).csv(path)
    header = raw.filter(F.array_contains(F.array("*"), DIRECTORY["code"])).limit(1).collect()
    if not header:
        raise ValueError(f"{path} has no header with {DIRECTORY['code']!r}")
    placed = {text: name for name, text in zip(raw.columns, header[0]) if text}
    missing = [text for text in DIRECTORY.values() if text not in placed]
    if missing:
        raise ValueError(f"school directory lacks {missing}")
    c = {ours: F.col(placed[text]) for ours, text in DIRECTORY.items()}
    schools = raw.filter((c["county"] == county) & (c["locality"] == locality)).select(
        c["code"].alias("code"), fix_diacritics(c["name"]).alias("name")
    )
    if schools.isEmpty():
        raise ValueError(f"no schools of {locality} ({county}) in {path}")
    return schools


def restrict_to_schools(results: DataFrame, directory: DataFrame, code: str = "school_code") -> DataFrame:
    """Results of the directory's schools."""
    return results.join(directory.select(F.col("code").alias(code)).distinct(), code, "left_semi")


def observed_schools(directory: DataFrame, results: DataFrame, code: str = "school_code") -> DataFrame:
    """Schools of the directory that have results."""
    return directory.join(results.select(F.col(code).alias("code")).distinct(), "code", "left_semi")

