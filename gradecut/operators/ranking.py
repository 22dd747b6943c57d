"""Ranks, even samples and picks that never put one group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradecut.session import checked_broadcast, cut_lineage

MAX_CELLS = 100_000
MAX_CELL_ROWS = 100_000


def rank_within(
    df: DataFrame,
    strata: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank",
    size: str = "stratum_size",
    weight: str | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Zero-based rank of every row inside its stratum, and the stratum's size.

    A plain window would sort a whole stratum in one task. Here the rows are range
    partitioned on stratum and order together, so a stratum holding a third of the table
    spans a third of the partitions; each row's rank is its place in its partition plus
    what the earlier partitions hold. ``order`` must tell apart all rows of a stratum,
    copies being folded into ``weight`` first. ``totals`` adds further sums per stratum.
    """
    strata = list(strata)
    keys = [F.col(c) for c in strata] + list(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The sampled ranges must not change between the two uses below.
    placed = cut_lineage(
        placed.withColumn("_part", F.spark_partition_id()).withColumn(
            "_at", F.monotonically_increasing_id()
        )
    )
    amount = F.lit(1) if weight is None else F.col(weight)
    totals = totals or {}
    parts = placed.groupBy(*strata, "_part").agg(
        F.sum(amount).alias("_n"),
        F.min("_at").alias("_first"),
        *[F.sum(value).alias(f"_t_{name}") for name, value in totals.items()],
    )
    earlier = Window.partitionBy(*strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*strata)
    parts = parts.select(
        *strata,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(size),
        *[F.sum(f"_t_{name}").over(whole).alias(name) for name in totals],
    )
    same = [placed[c].eqNullSafe(parts[c]) for c in [*strata, "_part"]]
    joined = placed.join(parts, on=same).drop(*[parts[c] for c in [*strata, "_part"]])
    if weight is None:
        here = F.col("_at") - F.col("_first")
    else:
        run = Window.partitionBy(*strata, "_part").orderBy("_at")
        here = F.coalesce(F.sum(weight).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn(rank, F.col("_before") + here).drop("_part", "_at", "_first", "_before")


def _picks_below(rank: Column, size: Column, count: Column) -> Column:
    """How many of the ``count`` evenly spaced positions lie below ``rank``."""
    step = size / count.cast("double")
    guess = F.ceil(rank / step)
    place = lambda i: F.floor(i * step)
    first = (
        F.when(place(guess - 1) >= rank, guess - 1)
        .when(place(guess) >= rank, guess)
        .otherwise(guess + 1)
    )
    return F.least(count, F.greatest(F.lit(0), first)).cast("bigint")


def even_sample(
    df: DataFrame, strata: Sequence[str], order: Sequence[str], count: int | Column, distinct: bool = False, unique: bool = False
) -> DataFrame:
    """``count`` evenly spaced rows of every stratum in sort order; all rows of small strata.

    ``count`` may be a column of the stratum. Copies count as rows of their own; ``distinct``
    takes them as one, ``unique`` says that there are none. Deterministic: no random numbers are involved.

    Rows are first counted by cell, the leading two columns of ``order``. Running counts over
    the cells tell which of them hold a wanted position, and only their rows are ranked. On
    marks in hundredths there are at most 901 x 901 cells in a stratum, however many rows.
    """
    columns = df.columns
    count = F.lit(count) if isinstance(count, int) else count
    rows = df.distinct() if distinct else df
    cell = [*strata, *order[:2]]
    per_cell = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*strata)
    until = whole.orderBy(*order[:2]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = per_cell.withColumns({"_upto": F.sum("_n").over(until), "_size": F.sum("_n").over(whole)})

    def picked(low: Column, high: Column) -> Column:
        return _picks_below(high, F.col("_size"), count) - _picks_below(low, F.col("_size"), count)

    holding = placed.filter((F.col("_size") <= count) | (picked(F.col("_upto") - F.col("_n"), F.col("_upto")) > 0))
    names = {c: f"_cell_{i}" for i, c in enumerate(cell)}
    holding = checked_broadcast(
        holding.select(
            *[F.col(c).alias(n) for c, n in names.items()], (F.col("_upto") - F.col("_n")).alias("_earlier"), "_size", "_n"
        ),
        MAX_CELLS,
    )
    fullest = holding.agg(F.max("_n")).first()[0] or 0
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    near = df.join(holding, on=same).select(*columns, "_earlier", "_size")
    copies = F.lit(1).cast("bigint") if distinct else F.count(F.lit(1))
    if unique:
        folded = near.withColumn("_copies", F.lit(1).cast("bigint"))
    else:
        folded = near.groupBy(*columns, "_earlier", "_size").agg(copies.alias("_copies"))
    rest = [c for c in columns if c not in cell]
    keys = [F.col(c) for c in [*[c for c in order if c in rest], *[c for c in rest if c not in order]]] or [F.lit(0)]
    if fullest <= MAX_CELL_ROWS:  # a cell then fits one task, whatever the other columns hold
        run = Window.partitionBy(*cell).orderBy(*keys)
        before = F.coalesce(F.sum("_copies").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = folded.withColumn("_rank", before)
    else:
        ranked = rank_within(folded, cell, keys, "_rank", "_cell_size", weight=None if distinct else "_copies")
    low = F.col("_earlier") + F.col("_rank")
    taken = F.when(F.col("_size") <= count, F.col("_copies")).otherwise(picked(low, low + F.col("_copies")))
    return (
        ranked.withColumn("_taken", taken)
        .filter("_taken > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_taken").cast("int"))))
        .select(*columns)
    )


def pick_representative(
    pages: DataFrame,
    groups: Sequence[str],
    count: int,
    size_col: str = "bytes",
    url_col: str = "url",
    trivial_below: int = 512,
) -> DataFrame:
    """Up to ``count`` pages per group that differ in size, largest first.

    The largest, the smallest that is not trivial, the median, then an even stride, then
    from the top. Adds ``pick_rank``, the place in the group's size order.
    """
    if count <= 0:
        return pages.withColumn("pick_rank", F.lit(0).cast("bigint")).limit(0)
    ranked = rank_within(
        pages,
        groups,
        [F.col(size_col).desc(), F.col(url_col).asc()],
        "pick_rank",
        "_n",
        totals={"_full": (F.col(size_col) >= trivial_below).cast("bigint")},
    )
    n = F.col("_n")
    last = F.when(F.col("_full") > 0, F.col("_full") - 1).otherwise(n - 1)
    stride = n / F.lit(float(count + 1))
    strided = [F.least(n - 1, F.floor(stride * k + 0.5)) for k in range(1, count + 1)]
    top = [F.lit(k).cast("bigint") for k in range(count)]
    wanted = [F.lit(0).cast("bigint"), last, F.floor(n / 2), *strided, *top]
    chosen = F.slice(F.array_distinct(F.array(*[w.cast("bigint") for w in wanted])), 1, count)
    keep = (n <= count) | F.array_contains(chosen, F.col("pick_rank"))
    return ranked.filter(keep).drop("_n", "_full")


def last_write_wins(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The row with the highest ``sequence`` of every key, combined before the shuffle.

    Among equal ones the row whose remaining columns are largest wins, so that the choice is the
    same in every run.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(sequence, *[c for c in rest if c != sequence])).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def first_n(df: DataFrame, order: Sequence[Column], count: int) -> DataFrame:
    """The first ``count`` rows in order, for reports and error messages."""
    return df.orderBy(*order).limit(count)
