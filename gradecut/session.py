"""Session defaults and the two helpers that decide how data is shared between stages."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app: str = "gradecut",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: the submit command
    names the master and adaptive execution coalesces the shuffle partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder, because there every
    executor is this machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="gradecut-")
    sc.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one run under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


_folders: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that its path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Remove at the end what ``cut_lineage`` has written inside.

    Gives a function that writes a table which outlives the block: whatever is used after it must
    have gone through that function, and must no longer need the removed tables.
    """
    outer, own = _folders.get(), []
    token = _folders.set(own)

    def keep(df: DataFrame) -> DataFrame:
        inner = _folders.set(outer)
        try:
            return cut_lineage(df)
        finally:
            _folders.reset(inner)

    try:
        yield keep
    finally:
        _folders.reset(token)
        for path in own:
            remove_folder(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Losing executors then never recomputes what led to it, later reads prune columns and
    filters, and the optimizer knows the true size when it chooses a join.
    """
    path = shared_path(df.sparkSession, "stage")
    if (made := _folders.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after counting that it holds at most ``max_rows`` rows.

    The table is materialised first, so the check does not run its plan a second time.
    Above the bound the table is returned without a hint and the join shuffles, with
    adaptive execution splitting whatever key is hot.
    """
    small = cut_lineage(df)
    if small.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(small)
    return small
