"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Every component of the integer vectors is a list of (row, value) sorted by value. For a query,
lists of its positive components are read from the top and those of its negative ones from the
bottom, all to the same depth. A row's lower bound takes its values read so far and the worst
value of every list not yet read for it; its upper bound takes the value reached by the reading
instead, and a row not seen at all is bounded by the values reached alone. Reading goes on, in
steps of ``STEPS``, until no row outside can qualify: rows whose upper bound is below the k-th
largest lower bound are out (equal ones stay, for ties). The final scores of the rows left are
then resolved, and the best k kept, ties to the smaller id.

A stated query set meets all rows in blocks: rows are dealt to blocks of about ``ROW_BLOCK``,
queries to blocks of about ``QUERY_BLOCK``, and every pair of blocks is one unit of work with its
own sorted lists, bounds and best k. The lists of a block serve all queries of the unit, so
reading is shared and bounds are matrix products. The units' bests, k for each query and block,
are merged by aggregation in two levels, which first folds what lies together.

Vectors that are null, or hold a null or non-finite component, take no part, nor do rows with a
null id. Shorter vectors count as filled up with zeros. Rows that repeat an id count once, with
the smallest vector in array order. Empty vectors score zero. Other columns are ignored.
Components beyond the exact range of doubles in products (2 ** 53) raise an error.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import cut_lineage

K = 20
EVERY = 20
SCALE = 64
ROW_BLOCK = 2048
QUERY_BLOCK = 1024
MERGE = 64
STEPS = (0.02, 0.08, 0.2, 0.4, 0.7)

FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantized(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as bigint; null if the vector takes no part."""
    sound = F.forall(
        embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.when(sound, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class SortedLists:
    """The lists of a block of rows, read from both ends in steps."""

    def __init__(self, rows: np.ndarray) -> None:
        self._rows = rows
        self._order = np.argsort(rows, axis=0, kind="stable")
        self._ends = np.take_along_axis(rows, self._order, axis=0)
        self._read = 0
        low, high = self._ends[0], self._ends[-1]
        # what a row is known to have at least and at most: nothing has been read
        self.from_top = (np.broadcast_to(low, rows.shape).copy(), np.broadcast_to(high, rows.shape).copy())
        self.from_bottom = (np.broadcast_to(low, rows.shape).copy(), np.broadcast_to(high, rows.shape).copy())

    def read(self, depth: int) -> None:
        """Read every list on to ``depth`` rows from its top and from its bottom."""
        depth = min(depth, len(self._rows))
        n = len(self._rows)
        for (least, most), part, reached in (
            (self.from_top, slice(n - depth, n - self._read), n - depth),
            (self.from_bottom, slice(self._read, depth), depth - 1),
        ):
            at, values = self._order[part], self._ends[part]
            np.put_along_axis(least, at, values, axis=0)
            np.put_along_axis(most, at, values, axis=0)
            bound = self._ends[reached]
            if least is self.from_top[0]:
                np.minimum(most, np.maximum(bound, least), out=most)
            else:
                np.maximum(least, np.minimum(bound, most), out=least)
        self._read = depth


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int = K):
    """(query id, row id, score) of each query's k best rows of a block."""
    if not len(queries) or not len(rows):
        return [], [], []
    reach = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if reach >= 2**53:
        raise ValueError("vector components are too large for exact products")
    kind = np.float32 if reach < 2**24 else np.float64
    q, x = queries.astype(kind), rows.astype(kind)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    lists = SortedLists(x)
    left = np.arange(len(q))  # queries whose outsiders may still qualify
    inside = [None] * len(q)
    floor = np.full(len(q), -np.inf)
    want = min(k + 1, len(x))  # one more, for the query's own row
    for step in STEPS:
        if not len(left) or len(x) <= want:
            break
        lists.read(max(1, int(step * len(x))))
        lower = up[left] @ lists.from_top[0].T + down[left] @ lists.from_bottom[1].T
        upper = up[left] @ lists.from_top[1].T + down[left] @ lists.from_bottom[0].T
        floor[left] = np.maximum(floor[left], np.partition(lower, len(x) - want, axis=1)[:, len(x) - want])
        may = upper >= floor[left][:, None]
        few = may.sum(axis=1) <= 4 * want
        for i in np.flatnonzero(few):
            inside[left[i]] = np.flatnonzero(may[i])
        left = left[~few]
    out_q, out_v, out_s = [], [], []
    for i, qid in enumerate(query_ids):
        mine = inside[i] if inside[i] is not None else np.arange(len(x))
        mine = mine[row_ids[mine] != qid]
        score = x[mine] @ q[i]
        if len(mine) > k:
            keep = score >= np.partition(score, len(mine) - k)[len(mine) - k]
            mine, score = mine[keep], score[keep]
        order = np.lexsort((row_ids[mine], -score))[:k]
        out_q += [qid] * len(order)
        out_v += row_ids[mine[order]].tolist()
        out_s += score[order].astype(np.int64).tolist()
    return out_q, out_v, out_s


def _unit(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    width = max(map(len, frame["vector"]), default=0) or 1
    matrix = np.zeros((len(frame), width), np.int64)
    for i, vector in enumerate(frame["vector"]):
        matrix[i, : len(vector)] = vector
    ids, asks = frame["vec_id"].to_numpy(), frame["asks"].to_numpy()
    found = best_of_block(matrix[asks], ids[asks], matrix[~asks], ids[~asks], k)
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)), dtype="int64")


def _best(rows: DataFrame, by: list, k: int) -> DataFrame:
    """The k best (score, vec_id) of each group as an array."""
    packed = F.struct((-F.col("score")).alias("loss"), "vec_id")
    return rows.groupBy("query_id", *by).agg(F.slice(F.array_sort(F.collect_list(packed)), 1, k).alias("best"))


def top_k(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: the k rows of ``vectors`` (vec_id, vector) best for each row that ``queries`` picks."""
    sound = vectors.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    each = cut_lineage(sound.groupBy("vec_id").agg(F.min("vector").alias("vector")))
    n_rows, n_queries = each.agg(F.count("*"), F.count_if(queries)).first()
    row_blocks, query_blocks = -(-n_rows // ROW_BLOCK) or 1, -(-n_queries // QUERY_BLOCK) or 1
    block = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = each.select("vec_id", "vector", F.lit(False).alias("asks"), block(row_blocks).alias("row_block"), every(query_blocks).alias("query_block"))
    asked = each.filter(queries).select(
        "vec_id", "vector", F.lit(True).alias("asks"), every(row_blocks).alias("row_block"), block(query_blocks).alias("query_block")
    )
    units = rows.unionByName(asked).groupBy("row_block", "query_block")
    found = units.applyInPandas(lambda frame: _unit(frame, k), FOUND)
    merged = found
    if row_blocks > MERGE:
        part = F.pmod(F.xxhash64("vec_id"), F.lit(-(-row_blocks // MERGE)))
        merged = _best(merged.withColumn("part", part), ["part"], k).select("query_id", F.explode("best").alias("one"))
        merged = merged.select("query_id", F.col("one.vec_id").alias("vec_id"), (-F.col("one.loss")).alias("score"))
    return _best(merged, [], k).select("query_id", F.posexplode("best").alias("at", "one")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.loss")).alias("score")
    )


def search(embeddings: DataFrame, k: int = K) -> DataFrame:
    """Top k of every row whose vec_id is divisible by ``EVERY``, over floor(64 x) of the components."""
    vectors = embeddings.select("vec_id", quantized(F.col("embedding")).alias("vector"))
    return top_k(vectors, F.col("vec_id") % EVERY == 0, k)
