"""Published generations: a numbered log of pointers over complete, validated snapshots.

A generation is written to a folder of its own and becomes readable by one pointer file in the log.
Pointers are numbered, and a number is created exclusively: a publisher that started from number n
takes n + 1 or fails, so of two that started alike one wins and the other's work is never readable.
Readers take the highest number whose pointer is whole. Nothing is renamed. Exclusive creation is
atomic where the file system's is (HDFS); the local one looks before it creates.

Publication reads its source once. The rules of single rows are counted by the pass that writes the
rows; what needs rows together (copies of a key, headers, index) comes from one aggregation of the
written columns. Only a refused publication reads the source again, to say what is wrong.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from gradecut.operators import contracts, sets
from gradecut.operators.contracts import ContractError, assert_clean
from gradecut.params import SCHEMA_VERSION
from gradecut.schemas import OFFER
from gradecut.session import remove_folder

ROW_ORDER = ("year", "county", "school_code", "spec_id")
WRITTEN = T.StructType([*OFFER.fields, T.StructField("provenance", T.StringType()), T.StructField("source", T.StringType())])
POINTER = "generation string, generated_at string, published_at timestamp"


class ConflictError(RuntimeError):
    """Another publisher was faster."""


# --- files ----------------------------------------------------------------------------


def _file(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet; False if it is."""
    system, place = _file(spark, path)
    if not system.createNewFile(place):
        return False
    stream = system.create(place, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def _names(spark: SparkSession, path: str) -> dict[str, float]:
    """Names in a folder and when they were last changed, in seconds; none if it is not there."""
    system, place = _file(spark, path)
    if not system.exists(place):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in system.listStatus(place)}


# --- the log --------------------------------------------------------------------------


def versions(spark: SparkSession, root: str) -> DataFrame:
    """version, generation, generated_at and published_at of every whole pointer."""
    try:
        lines = spark.read.text(f"{root}/log", wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"version bigint, {POINTER}")
    version = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("bigint")
    read = lines.select(version.alias("version"), F.from_json("value", POINTER).alias("p"))
    return read.filter(F.col("p.generation").isNotNull()).select("version", "p.*")


def last_number(spark: SparkSession, root: str) -> int:
    """The highest number taken, whole or not; 0 if there is none."""
    return max((int(n.split(".")[0]) for n in _names(spark, f"{root}/log") if n[0].isdigit()), default=0)


def commit(spark: SparkSession, root: str, generation: str, generated_at: str, base: int) -> int:
    """Make a written generation readable as number ``base`` + 1."""
    number = base + 1
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    pointer = {"generation": generation, "generated_at": generated_at, "published_at": now}
    if not _create(spark, f"{root}/log/{number:012d}.json", json.dumps(pointer)):
        raise ConflictError(f"number {number} was published by another publisher; start again from there")
    return number


def current_generation(spark: SparkSession, root: str) -> str | None:
    """Name of the newest complete generation."""
    newest = versions(spark, root).orderBy(F.desc("version")).first()
    return None if newest is None else newest["generation"]


# --- writing --------------------------------------------------------------------------


def headers_of(offers: DataFrame, generated_at: str) -> DataFrame:
    """One header per dataset, its sources sorted and distinct: one per delivered file."""
    return offers.groupBy("year", "county").agg(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(generated_at).alias("generated_at"),
        F.max("provenance").alias("provenance"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def _filed(offers: DataFrame) -> DataFrame:
    """Offers with the dataset each row was filed under, its own where nothing else is said."""
    for column, own in (("dataset_year", "year"), ("dataset_county", "county")):
        if column not in offers.columns:
            offers = offers.withColumn(column, F.col(own))
    return offers


def _datasets(written: DataFrame, generated_at: str) -> DataFrame:
    """Header and index entry of each dataset, and how many of its keys occur twice; copies fold first."""
    hashes = [F.sum(sets.row_hash(WRITTEN.fieldNames(), k).cast("decimal(38,0)")).alias(f"digest{k}") for k in (1, 2)]
    once = written.groupBy(*ROW_ORDER).agg(
        F.count(F.lit(1)).alias("n"), F.max("provenance").alias("provenance"), F.collect_set("source").alias("sources"), *hashes
    )
    path = F.concat(F.col("year").cast("string"), F.lit("/"), F.col("county"), F.lit(".json"))
    return once.groupBy("year", "county").agg(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(generated_at).alias("generated_at"),
        F.max("provenance").alias("provenance"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.sum("n").alias("row_count"),
        F.count_if(F.col("n") > 1).alias("copied_keys"),
        *[F.sum(f"digest{k}").alias(f"digest{k}") for k in (1, 2)],
    ).withColumn("path", path)


def write_generation(offers: DataFrame, root: str, generated_at: str, generation: str) -> DataFrame:
    """Write and validate a generation that nobody reads yet. Returns its index."""
    spark = offers.sparkSession
    target = f"{root}/generations/{generation}"
    if not _create(spark, f"{target}/_claimed", generated_at):
        raise ContractError(f"generation {generation} already exists")
    filed = _filed(offers)
    rules = contracts.offer_rules() + contracts.filing_rules()
    seen = Observation(f"publish {generation}")
    broken = [F.count_if(F.coalesce(rule[2], F.lit(False))).alias(f"rule{i}") for i, rule in enumerate(rules)]
    # counted above the exchange, in the tasks whose output is committed: a task that runs again counts once
    (
        filed.hint("rebalance", F.col("year"), F.col("county"))
        .sortWithinPartitions(*ROW_ORDER)
        .observe(seen, F.count(F.lit(1)).alias("rows"), *broken)
        .select(*WRITTEN.fieldNames())
        .write.mode("error")
        .partitionBy("year", "county")
        .parquet(f"{target}/offers")
    )
    written = spark.read.schema(WRITTEN).parquet(f"{target}/offers")
    _datasets(written, generated_at).write.mode("error").parquet(f"{target}/datasets")
    datasets = spark.read.parquet(f"{target}/datasets")
    totals = datasets.agg(F.sum("row_count"), F.sum("copied_keys")).first()
    if not totals[0]:
        raise ContractError("nothing to publish")
    counted = seen.get
    wrong = {f"{rule[1]}: {rule[3]}": counted[f"rule{i}"] for i, rule in enumerate(rules) if counted[f"rule{i}"]}
    if wrong or totals[1]:
        assert_clean(contracts.dataset_violations(headers_of(offers, generated_at), filed), "offers")
        raise ContractError(f"offers broke their contract: {wrong}, {totals[1]} keys more than once")
    assert_clean(contracts.header_violations(datasets), "headers")
    assert_clean(contracts.index_violations(datasets), "index")
    if counted["rows"] != totals[0]:
        raise ContractError(f"{counted['rows']} rows were written and {totals[0]} are there")
    return _index(spark, target)


def publish(offers: DataFrame, root: str, generated_at: str, generation: str, base: int | None = None) -> DataFrame:
    """Publish a complete, validated generation; readers see the old one until it is whole.

    ``base`` is the number the publisher's work started from, by default the log's last one. A
    failure at any step leaves the log as it was and removes what was written; what a lost publisher
    left behind is removed by ``expire``. Returns the index of the generation.
    """
    spark = offers.sparkSession
    base = last_number(spark, root) if base is None else base
    target = f"{root}/generations/{generation}"
    claimed = "_claimed" in _names(spark, target)
    try:
        index = write_generation(offers, root, generated_at, generation)
        commit(spark, root, generation, generated_at, base)
    except Exception:
        if not claimed:
            remove_folder(spark, target)
        raise
    return index


def expire(spark: SparkSession, root: str, keep: int = 2, grace_seconds: float = 7 * 86400) -> list[str]:
    """Remove generations that are no longer among the newest ``keep`` and older than the grace period.

    That is also true of generations that were never published. Pointers go before the data they
    name. Readers that started within the grace period keep what they read. Returns what was removed.
    """
    horizon = datetime.now(UTC).timestamp() - grace_seconds
    log = sorted((tuple(r) for r in versions(spark, root).select("version", "generation", F.unix_micros("published_at") / 1e6).collect()), reverse=True)
    stays = {g for n, (_, g, at) in enumerate(log) if n < max(1, keep) or at >= horizon}
    for version, generation, _ in log:
        if generation not in stays:
            remove_folder(spark, f"{root}/log/{version:012d}.json")
    dropped = []
    for name in stored_generations(spark, root):
        claimed = _names(spark, f"{root}/generations/{name}").get("_claimed", 0)
        if name not in stays and claimed < horizon:
            remove_folder(spark, f"{root}/generations/{name}")
            dropped.append(name)
    return dropped


def stored_generations(spark: SparkSession, root: str) -> list[str]:
    """Names of all generations that take up space, readable or not."""
    return sorted(_names(spark, f"{root}/generations"))


# --- reading --------------------------------------------------------------------------


def _target(spark: SparkSession, root: str, version: int | None) -> str:
    log = versions(spark, root)
    row = (log if version is None else log.filter(F.col("version") == version)).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"nothing published under {root}" if version is None else f"no number {version} under {root}")
    return f"{root}/generations/{row['generation']}"


def read_published(
    spark: SparkSession, root: str, county: str | None = None, year: int | None = None, version: int | None = None
) -> DataFrame:
    """Offers of the current generation, or of an earlier number; a county or year prunes whole folders."""
    offers = spark.read.parquet(f"{_target(spark, root, version)}/offers")
    if county is not None:
        offers = offers.filter(F.col("county") == county)
    if year is not None:
        offers = offers.filter(F.col("year") == year)
    return offers


def _index(spark: SparkSession, target: str) -> DataFrame:
    listed = spark.read.parquet(f"{target}/datasets")
    return listed.select("year", "county", "path", "row_count", "provenance").orderBy(F.col("year").desc(), "county")


def read_index(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    return _index(spark, _target(spark, root, version))


def changed_datasets(offers: DataFrame, root: str, version: int | None = None) -> list[tuple[int, str]]:
    """year and county of the datasets in which ``offers`` differ from a published generation.

    The generation's digests were stored when it was written, so only ``offers`` is read.
    """
    spark = offers.sparkSession
    stored = spark.read.parquet(f"{_target(spark, root, version)}/datasets").withColumnRenamed("row_count", "rows")
    typed = offers.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in WRITTEN])
    own = sets.digests(typed, ["year", "county"], WRITTEN.fieldNames())
    return sorted((r["year"], r["county"]) for r in sets.changed_groups(stored, own, ["year", "county"]).collect())


def read_datasets(spark: SparkSession, root: str, wanted: list[tuple[int, str]], version: int | None = None) -> DataFrame:
    """Published offers of those of the given datasets that are published; only their folders are listed and read."""
    target = _target(spark, root, version)
    there = _index(spark, target).filter(_among(wanted)).select("year", "county").collect()
    folders = [f"{target}/offers/year={year}/county={county}" for year, county in there]
    if not folders:
        return spark.createDataFrame([], WRITTEN)
    return spark.read.schema(WRITTEN).option("basePath", f"{target}/offers").parquet(*folders)


def _among(wanted: list[tuple[int, str]]):
    found = F.lit(False)
    for year in sorted({y for y, _ in wanted}):
        found = found | ((F.col("year") == year) & F.col("county").isin([c for y, c in wanted if y == year]))
    return found


def differences(offers: DataFrame, root: str, version: int | None = None) -> DataFrame:
    """Rows that only ``offers`` or only the published generation has, from the datasets that differ."""
    wanted = changed_datasets(offers, root, version)
    published = read_datasets(offers.sparkSession, root, wanted, version)
    return sets.snapshot_difference(published, offers.select(*WRITTEN.fieldNames()).filter(_among(wanted)))
