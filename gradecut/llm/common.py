"""Helpers that several operators share: Arrow column functions, bounded samples, blocks."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradecut.session import cut_lineage, shared_path

BATCH_ROWS = 1_000
BATCH_BYTES = 8 << 20

__all__ = ["arrow_column", "bound_batches", "bounded_sample", "cut_lineage", "fresh", "held_out", "read_table", "shared_path", "training_ids"]


def bound_batches(spark) -> None:
    """Hand texts to Python in batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` from now on.

    By default a batch has 10,000 rows of any length, several copies of which are in memory at once on
    either side. A session that asks for less keeps its own setting.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < held <= most:
            spark.conf.set(key, str(most))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, in a session with bounded batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column that Spark would take for it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_column(make: Callable[[], Callable[[pa.Array], pa.Array]], return_type) -> Callable[..., Column]:
    """A column function over Arrow batches.

    ``make`` runs once for each task and returns the function of a batch, so that what it
    prepares (a model taken from a broadcast, a lookup table) is shared by all batches.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for batch in batches:
            yield apply(batch)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return F.arrow_udf(run, returnType=return_type)


def held_out(doc_id, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def bounded_sample(df: DataFrame, group: str, key: str, per_group: int) -> DataFrame:
    """At most ``per_group`` rows of each value of ``group``, the same ones in every run.

    Rows are taken by the hash of ``key``. The groups' counts, which aggregate before any
    shuffle, give a threshold that lets through slightly more rows than wanted, and only
    those are ranked: no window ever holds more than about ``1.5 * per_group + 100`` rows.
    """
    spark = df.sparkSession
    counts = df.groupBy(group).count().collect()
    if not counts:
        return df.limit(0)
    spread = float(2**40)
    limits = spark.createDataFrame(
        [(r[0], min(spread, spread * (1.25 * per_group + 50) / r[1])) for r in counts],
        f"_group {df.schema[group].dataType.simpleString()}, _limit double",
    )
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(2**40))
    few = (
        df.withColumn("_drawn", drawn)
        .join(F.broadcast(limits), F.col(group).eqNullSafe(F.col("_group")))
        .filter(F.col("_drawn") < F.col("_limit"))
        .drop("_group", "_limit")
    )
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_drawn", key)))
    return ranked.filter(F.col("_rank") <= per_group).drop("_drawn", "_rank")


def training_ids(documents: DataFrame, marked: DataFrame, group: str, per_group: int, most_chars: int) -> DataFrame:
    """doc_id and ``group`` of at most ``per_group`` documents of each value to learn from.

    Only documents of ``marked`` (doc_id, group) whose text has a character are drawn from. Texts of
    up to ``most_chars`` come first; where a group has too few of them, longer ones fill up, of which
    the caller learns from the first ``most_chars``.
    """
    texts = documents.select("doc_id", (F.char_length("text") > most_chars).alias("_long")).filter(F.char_length("text") > 0)
    found = marked.select("doc_id", group).join(texts, "doc_id").groupBy("doc_id", group).agg(F.min("_long").alias("_long"))
    kinds = found.withColumn("_kind", F.concat_ws(" ", F.col("_long").cast("string"), F.col(group).cast("string")))
    few = bounded_sample(cut_lineage(kinds), "_kind", "doc_id", per_group)  # at most 2 * per_group of each value
    order = Window.partitionBy(group).orderBy("_long", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), "doc_id")
    ranked = few.withColumn("_place", F.row_number().over(order))
    return ranked.filter(F.col("_place") <= per_group).select("doc_id", group)
