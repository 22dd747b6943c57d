"""Running verification of arriving results, first sight of pages, and the last write of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gradecut.functions.urls import canonical_url
from gradecut.operators.evaluate import media_counters
from gradecut.operators.ranking import last_write_wins


def read_arriving(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """Parquet files as they arrive under ``path`` (a folder or a pattern)."""
    reader = spark.readStream.schema(schema)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def running_verification(results: DataFrame) -> DataFrame:
    """Counts by outcome and papers; the state has six keys at most."""
    return media_counters(results)


def first_seen_pages(
    pages: DataFrame, url: str = "url", fetched_at: str | None = None, horizon: str = "1 day"
) -> DataFrame:
    """The first page of each canonical address.

    With a fetch time the state forgets addresses once they are older than ``horizon``;
    without one every address is kept, on the executors' state store.
    """
    canonical = pages.withColumn("canonical_url", canonical_url(F.col(url)))
    if fetched_at is None:
        return canonical.dropDuplicates(["canonical_url"])
    return canonical.withWatermark(fetched_at, horizon).dropDuplicatesWithinWatermark(["canonical_url"])


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what has arrived and stop; appended rows land in ``path`` exactly once."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; ``read_counts`` gives the latest complete counts.

    Each batch is written to a folder of its own, a repeated batch over its own earlier try,
    and only then named in the list of finished batches, so readers never see half of one.
    """

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/{number}")
        done = batch.sparkSession.range(1).select(F.lit(number).cast("bigint").alias("batch"))
        done.coalesce(1).write.mode("append").parquet(f"{path}/finished")

    query = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )
    query.awaitTermination()
    return query


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of the last finished batch of ``run_counts``."""
    last = spark.read.parquet(f"{path}/finished").agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{path}/batches/{last}")


def run_last_writes(arriving: DataFrame, keys: list[str], sequence: str, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; ``read_last_writes`` gives the last write of every key so far.

    The state store holds one row a key, whatever its order of arrival: a late earlier write changes
    nothing. A batch writes the keys that it touched to a folder of its own, a repeated batch over its
    own earlier try, and is then named as finished. A query that is started again goes on from there.
    """
    newest = last_write_wins(arriving, keys, sequence)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        done = batch.sparkSession.range(1).select(F.lit(number).cast("bigint").alias("batch"))
        done.coalesce(1).write.mode("append").parquet(f"{path}/finished")

    query = (
        newest.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(append)
        .start()
    )
    query.awaitTermination()
    return query


def read_last_writes(spark: SparkSession, keys: list[str], path: str) -> DataFrame:
    """The last write of every key, from the finished batches; the latest batch that touched a key has it."""
    finished = spark.read.parquet(f"{path}/finished").distinct()
    touched = spark.read.parquet(f"{path}/batches").join(F.broadcast(finished), "batch", "left_semi")
    return last_write_wins(touched, keys, "batch").drop("batch")
