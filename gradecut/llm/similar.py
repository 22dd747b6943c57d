"""Near duplicates by Jaccard similarity: SimHash and MinHash bands propose pairs, whole shingle sets decide.

A text's set holds the XXH64 values of its word shingles as in ``simhash`` (fewer words than
``SHINGLE``: all of them as one). Texts with equal sets are one node; null texts and texts without
a word have the empty set and are one node too. Two nodes are linked if their sets' Jaccard
similarity is at least ``SIMILARITY``; a group is a component of these links.

Candidates are first what ``simhash`` links: every node with the smallest node of its component in the
trie join of the texts' fingerprints. At 0.8 fingerprints differ in more bits than its budget allows, so
other candidates share a bucket: one of ``BANDS`` bands of ``ROWS`` MinHash values each. A pair at
similarity s has no bucket in common with probability (1 - s ** ROWS) ** BANDS, 1 in 1,000 at 0.8
and 1 in 80,000 at 0.85; a pair at 0.5 has one with 9 in 100.

Links are found in two rounds, so that no pairs of a group are listed. First each node is compared,
set by set, with the smallest node of its fingerprint's component and of each of its buckets: at most
``BANDS`` + 1 pairs a text. A bucket
whose nodes are then in one component is settled. The nodes of every other bucket meet in a unit of
work (full buckets are dealt to blocks of ``BLOCK`` nodes, and each pair of blocks is a unit) with
their MinHash values and, up to ``SMALL`` shingles, their sets. A unit looks at pairs from
different components whose sizes and estimates allow ``SIMILARITY`` (``DOUBT`` standard deviations
below it), decides those of small sets exactly and hands on a spanning forest of the linked ones.
Pairs with a larger set are handed on as a forest too, checked outside set by set, and where one
fails, the pairs left across components are checked in a last round.

Every text is taken whole. Repeated rows are one node and one of them stays; of rows with one id the
one whose text hash is smallest; a null id counts after all others. An empty table gives an empty result.
The documents' own columns stay, whatever they are called. What is written on the way is removed.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm import simhash
from gradecut.llm.common import arrow_column, cut_lineage
from gradecut.session import scratch

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 48
ROWS = 9
BLOCK = 1024
SMALL = 2048
DOUBT = 5
HOT = 1000
SLACK = 1e-9

_PART = 256
_RANDOM = np.random.RandomState(42)
_FLIP = _RANDOM.randint(0, 1 << 32, BANDS * ROWS, np.uint32)
_FACTOR = _RANDOM.randint(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted."""
    return np.unique(simhash.shingle_hashes(text, size)) if text else np.zeros(0, np.uint64)


def least_values(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for start in range(0, len(short), _PART):
        mixed = (short[start : start + _PART] ^ _FLIP[:, None]) * _FACTOR[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """Bucket of each band; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    buckets = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least_values(shingles).astype(np.uint64).reshape(BANDS, ROWS).T:
        buckets = (buckets ^ row) * _MIX
        buckets ^= buckets >> np.uint64(29)
    return buckets.view(np.int64)


def _marks(text: Column, size: int) -> Column:
    """Hash of the whole set, how many shingles are in it, and its buckets."""

    def make():
        def apply(batch: pa.Array) -> pa.Array:
            nodes, sizes, buckets = [], [], []
            for text in batch:
                own = shingle_set(text.as_py(), size)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                buckets.append(bands_of(own))
            ends = np.cumsum([0, *map(len, buckets)])
            flat = np.concatenate([np.zeros(0, np.int64), *buckets])
            return pa.StructArray.from_arrays(
                [
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                ["node", "size", "buckets"],
            )

        return apply

    return arrow_column(make, "node bigint, size int, buckets array<bigint>")(text)


def _sets(text: Column, size: int) -> Column:
    """Sorted shingle hashes as bytes."""

    def make():
        return lambda batch: pa.array([shingle_set(t.as_py(), size).tobytes() for t in batch], pa.binary())

    return arrow_column(make, "binary")(text)


def _sketches(shingles: Column) -> Column:
    """Low halves of the MinHash values, and the set itself if it is small, from sets as bytes."""

    def make():
        def apply(batch: pa.Array) -> pa.Array:
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch]
            halves = [least_values(s).astype(np.uint16).tobytes() for s in sets]
            small = [s.tobytes() if len(s) <= SMALL else None for s in sets]
            return pa.StructArray.from_arrays([pa.array(halves, pa.binary()), pa.array(small, pa.binary())], ["sketch", "whole"])

        return apply

    return arrow_column(make, "sketch binary, whole binary")(shingles)


def jaccard(left: np.ndarray, right: np.ndarray) -> float:
    """Similarity of two sets of hashes."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both / (len(left) + len(right) - both)


def _similar(left: str, right: str, similarity: float) -> Column:
    """Whether two columns of ``_sets`` are at least that similar."""

    def make():
        def apply(batch: pa.Array) -> pa.Array:
            out = []
            for a, b in zip(batch.field(0), batch.field(1), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                near = min(len(x), len(y)) >= similarity * max(len(x), len(y)) - SLACK
                out.append(bool(near and jaccard(x, y) >= similarity - SLACK))
            return pa.array(out, pa.bool_())

        return apply

    return arrow_column(make, "boolean")(F.struct(left, right))


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= simhash.BROADCAST_PAIRS else df


def _attach(pairs: DataFrame, sets: DataFrame, side: str, hot: DataFrame) -> DataFrame:
    """``pairs`` with the set of ``side``; nodes of more than ``HOT`` pairs, at most one for each
    ``HOT`` pairs, are broadcast."""
    own = sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}"))
    hot = F.broadcast(hot)
    often = pairs.join(hot, side, "left_semi").join(F.broadcast(own.join(hot, side, "left_semi")), side)
    return pairs.join(hot, side, "left_anti").join(own, side).unionByName(often)


def sets_of(wanted: DataFrame, nodes: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """node and set (as bytes) of the nodes in ``wanted``, written."""
    wanted = cut_lineage(nodes.select("node", "text_hash").join(wanted, "node"))
    texts = documents.select("text", F.xxhash64("text").alias("text_hash")).join(_small(wanted), "text_hash")
    one = texts.groupBy("node").agg(F.first("text").alias("text"))
    return cut_lineage(one.select("node", _sets(F.col("text"), size).alias("set")))


def verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough."""
    spark = pairs.sparkSession
    pairs = cut_lineage(pairs)
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, documents, size)
    hot = {s: cut_lineage(pairs.groupBy(s).count().filter(F.col("count") > HOT).select(s)) for s in ("a", "b")}
    dealt = pairs.repartition(4 * spark.sparkContext.defaultParallelism, "a", "b")
    both = _attach(_attach(dealt, sets, "a", hot["a"]), sets, "b", hot["b"])
    return cut_lineage(both.filter(_similar("set_a", "set_b", similarity)).select("a", "b"))


class Unit:
    """Nodes that meet in one unit of work, and the links found between their components."""

    def __init__(self, nodes, sizes, roots, sketches, sets, similarity: float) -> None:
        self.nodes, self.sizes, self.sketches, self.sets = nodes, sizes, sketches, sets
        self.similarity = similarity
        _, self.group = np.unique(roots, return_inverse=True)
        least = max(0.0, similarity - DOUBT * (similarity * (1 - similarity) / (BANDS * ROWS)) ** 0.5)
        self.least = least * BANDS * ROWS

    def join(self, i: int, j: int) -> None:
        self.group[self.group == self.group[j]] = self.group[i]

    def candidates(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``others`` that may be similar to ``i`` and are in other components, and their equal values."""
        near = np.minimum(self.sizes[others], self.sizes[i]) >= self.similarity * np.maximum(self.sizes[others], self.sizes[i]) - SLACK
        others = others[near & (self.group[others] != self.group[i])]
        equal = (self.sketches[others] == self.sketches[i]).sum(axis=1)
        return others[equal >= self.least], equal[equal >= self.least]

    def links(self, left: np.ndarray, right: np.ndarray | None, forest: bool) -> Iterator[tuple[int, int, bool]]:
        """(node, node, decided): a forest of links between small sets, and pairs that are yet to be checked."""
        open_pairs = []
        for at, i in enumerate(left):
            others, equal = self.candidates(i, left[at + 1 :] if right is None else right)
            for j, e in zip(others.tolist(), equal.tolist(), strict=True):
                if self.group[i] == self.group[j]:
                    continue
                if self.sets[i] is None or self.sets[j] is None:
                    open_pairs.append((-e, i, j))
                elif jaccard(self.sets[i], self.sets[j]) >= self.similarity - SLACK:
                    self.join(i, j)
                    yield self.nodes[i], self.nodes[j], True
        before = self.group.copy()
        for _, i, j in sorted(open_pairs):
            if (self.group if forest else before)[i] != (self.group if forest else before)[j]:
                if forest:
                    self.join(i, j)
                yield self.nodes[i], self.nodes[j], False


def _unit_links(similarity: float, forest: bool):
    def apply(rows: pa.Table) -> pa.Table:
        first = rows["unit"][0].as_py()
        block, sketches = rows["block"].to_numpy(), rows["sketch"].to_pylist()
        whole = [None if s is None else np.frombuffer(s, np.uint64) for s in rows["whole"].to_pylist()]
        unit = Unit(
            rows["node"].to_numpy(), rows["size"].to_numpy(), rows["root"].to_numpy(),
            np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), -1), whole, similarity,
        )
        left, right = np.flatnonzero(block == first["i"]), None
        if first["i"] != first["j"]:
            right = np.flatnonzero(block == first["j"])
        found = list(unit.links(left, right, forest))
        a, b, decided = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "decided": pa.array(decided, pa.bool_())})

    return apply


def unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """bucket, node, size and root of the buckets whose nodes are in several components, written.

    Of buckets with the same nodes one is kept.
    """
    roots = simhash.connected(links)
    known = members.join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = cut_lineage(known.select("bucket", "node", "size", "root"))
    kinds = known.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"),
        *(F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"sum{k}") for k in (1, 2)),
    )
    several = kinds.filter(F.col("low") < F.col("high")).groupBy("n", "sum1", "sum2").agg(F.min("bucket").alias("bucket"))
    several = cut_lineage(several.select("bucket", "n"))
    return cut_lineage(known.join(_small(several), "bucket"))


def unit_pairs(left: DataFrame, sketches: DataFrame, similarity: float, forest: bool) -> DataFrame:
    """a, b and whether decided, from units of ``left`` (bucket, node, size, root, n), written."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = left.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    dealt = placed.select("bucket", "node", "size", "root", "block", other)
    unit = F.struct(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("unit")
    rows = dealt.select("bucket", "node", "size", "root", "block", unit).join(sketches, "node")
    found = rows.groupBy("bucket", "unit").applyInArrow(_unit_links(similarity, forest), "a bigint, b bigint, decided boolean")
    return cut_lineage(found.distinct())


def marks_of(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node, size, buckets and fingerprint (print) of every row, written."""
    text = F.col("text")
    marked = documents.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), _marks(text, size).alias("m"), simhash.fingerprint(text).alias("print")
    )
    return cut_lineage(marked.select("doc_id", "text_hash", "m.*", "print"))


def fingerprint_pairs(marks: DataFrame) -> DataFrame:
    """Pairs (a, b): the smallest node of a component of fingerprints in ``simhash``, and each other one in it."""
    roots = simhash.components(marks.select("doc_id", F.col("print").alias("fp"))).select(F.col("fp").alias("print"), "root")
    placed = marks.filter("size > 0").select("node", "print").distinct().join(roots, "print")
    placed = cut_lineage(placed.select("node", "root").distinct())
    several = placed.groupBy("root").agg(F.min("node").alias("a"), F.max("node").alias("last"))
    several = cut_lineage(several.filter(F.col("a") < F.col("last")).select("root", "a"))
    return placed.join(_small(several), "root").filter(F.col("node") > F.col("a")).select("a", F.col("node").alias("b"))


def similar_links(marks: DataFrame, documents: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes, enough of them to connect each component."""
    nodes = cut_lineage(
        marks.groupBy("node").agg(
            F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("buckets").alias("buckets")
        )
    )
    entries = nodes.select("node", "size", F.explode("buckets").alias("bucket"))
    shared = cut_lineage(
        entries.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
        .filter(F.col("leader") < F.col("last")).select("bucket", "leader")
    )
    members = cut_lineage(entries.join(_small(shared), "bucket"))
    near = F.col("node") > F.col("leader")
    pairs = members.filter(near).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = pairs.unionByName(fingerprint_pairs(marks)).distinct()
    links = verified(pairs, nodes, documents, size, similarity)

    # pairs with a leader are settled; of the others only those across components matter
    for forest in (True, False):
        left = unsettled(members, links)
        if left.isEmpty():
            break
        sets = sets_of(left.select("node").distinct(), nodes, documents, size)
        sketches = cut_lineage(sets.select("node", _sketches(F.col("set")).alias("s")).select("node", "s.*"))
        found = unit_pairs(left, sketches, similarity, forest)
        open_pairs = cut_lineage(found.filter(~F.col("decided")).select("a", "b"))
        links = links.unionByName(found.filter("decided").select("a", "b"))
        if open_pairs.isEmpty():
            break
        sure = verified(open_pairs, nodes, documents, size, similarity)
        links = links.unionByName(sure)
        if sure.count() == open_pairs.count():
            break
    return links


def keep_one(documents: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, chosen as in ``simhash.keep_one``."""
    with scratch(documents.sparkSession) as keep:
        marks = marks_of(documents, size)
        prints = marks.select("doc_id", "text_hash", F.col("node").alias("fp"))
        links = similar_links(marks, documents, size, similarity)
        chosen = keep(simhash.first_of_each(prints, simhash.components(prints, links)))
    return simhash.keep_chosen(documents, chosen)
