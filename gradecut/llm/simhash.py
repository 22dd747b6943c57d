"""SimHash near duplicates: 64-bit fingerprints linked by a self-join over their binary trie.

Fingerprints. A-Z are lower-cased, words are runs of anything but space and tab to carriage
return, shingles are ``SHINGLE`` words in a row joined by a space, repeats included (fewer
words: all of them as one). A bit is set if it is set in over half the XXH64 values of the
shingles.

Join. Distinct fingerprints form a binary trie. Node pairs are traversed together from the pair
(root, root); the differing bits of the two paths are added up, and a pair is pruned as soon as
they exceed the error budget. The top of the trie, down to nodes of at most ``LARGEST_UNIT`` fingerprints,
is walked over a histogram of the first ``TOP_BITS`` bits; each surviving node pair is one unit of
work that Spark deals out, and a unit walks its two subtrees down to small leaf blocks, which are
compared bit by bit. Nothing is emitted but the spanning links of a unit (at most one for each
fingerprint in it). Within a unit the budget is raised one bit at a time, and node pairs that are
already wholly in one component are skipped, so that a large group of near copies costs about its
size and not its square.

Components. The units' links are contracted by alternating star steps between written tables.

Null, empty and wordless texts have fingerprint zero and are linked like any others. Repeated
rows and ids each keep their row. ``component_id`` is the smallest doc_id that can be reached;
null ids never win, and it is null only if all ids of a component are. Other columns of the input
are ignored; an empty table gives an empty result.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import arrow_column, cut_lineage, fresh
from gradecut.session import scratch

SHINGLE = 3
SEED = 42
BUDGET = 3
TOP_BITS = 16
LEAST_UNIT = 1 << 10
NODES_WANTED = 12
LARGEST_UNIT = 1 << 17
BROADCAST_PAIRS = 1_000_000
LEAF = 16
AT_ONCE = 1 << 18

_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_PART = 4096


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, in order."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(" ".join(words).encode("utf-8", "replace"), SEED)], np.uint64)
    shifted = zip(*(words[i:] for i in range(size)), strict=False)
    return np.array([digest(" ".join(s).encode("utf-8", "replace"), SEED) for s in shifted], np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as an unsigned number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), _PART):
        part = hashes[start : start + _PART].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """Fingerprint of the whole text as a signed 64-bit number."""

    def make():
        def apply(batch: pa.Array) -> pa.Array:
            found = np.array([fingerprint_of(shingle_hashes(t)) if t else 0 for t in batch.to_pylist()], np.uint64)
            return pa.array(found.view(np.int64))

        return apply

    return arrow_column(make, "bigint")(text)


def _roots(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels of the components after adding links; ``parent`` holds labels before (roots point to themselves)."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the ones begin at ``bit`` (0 is the highest) in each sorted range whose higher bits agree."""
    mark = np.uint64(1) << (np.uint64(63) - bit.astype(np.uint64))
    start = (values[low] & ~(mark | (mark - np.uint64(1)))) | mark
    return np.clip(np.searchsorted(values, start), low, high)


def _blocks(values, al, ah, bl, bh, same, budget):
    """Links between the leaf blocks [al, ah) and [bl, bh) of each pair, all compared in full."""
    wide_a, wide_b = int((ah - al).max()), int((bh - bl).max())
    i = al[:, None] + np.arange(wide_a)
    j = bl[:, None] + np.arange(wide_b)
    inside_i, inside_j = i < ah[:, None], j < bh[:, None]
    x = values[np.minimum(i, len(values) - 1)]
    y = values[np.minimum(j, len(values) - 1)]
    near = np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= budget
    near &= inside_i[:, :, None] & inside_j[:, None, :]
    p, m, n = np.nonzero(near)
    left, right = i[p, m], j[p, n]
    keep = (left < right) | ~same[p]
    return left[keep], right[keep]


def trie_components(values: np.ndarray, middle: int | None = None, budget: int = BUDGET) -> np.ndarray:
    """Component labels of fingerprints, each label the smallest position of its component.

    ``values`` are sorted and distinct; with ``middle`` they are two sorted parts and only pairs
    across the parts are linked.
    """
    n = len(values)
    parent = np.arange(n)
    if n < 2 or middle in (0, n):
        return parent
    root = (0, n, 0, n) if middle is None else (0, middle, middle, n)
    for error in range(min(1, budget), budget + 1):
        change = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
        # rows: range of one node, range of the other, next bit, differing bits so far
        stack = [np.array([[*root, 0, 0]], np.int64)]
        while stack:
            pairs = stack.pop()
            if len(pairs) > AT_ONCE:
                stack.append(pairs[AT_ONCE:])
                pairs = pairs[:AT_ONCE]
            al, ah, bl, bh, bit, wrong = pairs.T
            alone = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (parent[al] == parent[bl])
            pairs = pairs[~alone]
            if not len(pairs):
                continue
            al, ah, bl, bh, bit, wrong = pairs.T
            small = ((ah - al <= LEAF) & (bh - bl <= LEAF)) | (bit >= 64)
            if small.any():
                leaf = pairs[small]
                for start in range(0, len(leaf), 1 << 14):
                    part = leaf[start : start + (1 << 14)]
                    same = part[:, 0] == part[:, 2]
                    left, right = _blocks(values, *part[:, :4].T, same, error)
                    if len(left):
                        parent = _roots(parent, left, right)
                change = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
            pairs = pairs[~small]
            if not len(pairs):
                continue
            al, ah, bl, bh, bit, wrong = pairs.T
            am, bm = _part_split(values, al, ah, bit, middle), _part_split(values, bl, bh, bit, middle)
            same = (al == bl) & (ah == bh)
            after = bit + 1
            children = [
                np.stack([al, am, bl, bm, after, wrong], 1),
                np.stack([am, ah, bm, bh, after, wrong], 1),
                np.stack([al, am, bm, bh, after, wrong + 1], 1),
                np.stack([am, ah, bl, bm, after, wrong + 1], 1)[~same],
            ]
            grown = np.concatenate(children)
            grown = grown[(grown[:, 1] > grown[:, 0]) & (grown[:, 3] > grown[:, 2]) & (grown[:, 5] <= error)]
            if len(grown):
                stack.append(grown)
    return parent


def _part_split(values, low, high, bit, middle):
    """Like ``_split``, where ``values`` may be two sorted parts that meet at ``middle``."""
    if middle is None:
        return _split(values, low, high, bit)
    out = np.empty_like(low)
    second = low >= middle
    out[~second] = _split(values[:middle], low[~second], high[~second], bit[~second])
    out[second] = middle + _split(values[middle:], low[second] - middle, high[second] - middle, bit[second])
    return out


def top_nodes(histogram: np.ndarray, unit: int) -> list[tuple[int, int, int]]:
    """Nodes (first bin, end bin, depth) that cut the trie where at most ``unit`` fingerprints are below."""
    total = np.concatenate(([0], np.cumsum(histogram)))
    out, stack = [], [(0, len(histogram), 0)]
    while stack:
        low, high, depth = stack.pop()
        inside = total[high] - total[low]
        if inside and (inside <= unit or high - low == 1):
            out.append((low, high, depth))
        elif inside:
            half = (low + high) // 2
            stack += [(half, high, depth + 1), (low, half, depth + 1)]
    return out


def node_pairs(nodes: list[tuple[int, int, int]], bits: int = TOP_BITS, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Pairs (i <= j) of nodes whose common path bits differ in at most ``budget``, by a walk from the roots."""
    low = np.array([n[0] for n in nodes])
    depth = np.array([n[2] for n in nodes])
    pairs, out = [(0, len(nodes), 0, len(nodes), 0, 0)], []
    while pairs:
        al, ah, bl, bh, bit, wrong = pairs.pop()
        if ah - al == 1 and bh - bl == 1:
            shared = min(depth[al], depth[bl])
            x = (int(low[al]) ^ int(low[bl])) >> (bits - shared) if shared else 0
            if x.bit_count() <= budget:
                out.append((al, bl))
            continue
        mark = 1 << (bits - 1 - bit)

        def parts(start, stop, mark=mark, bit=bit):
            if stop - start == 1 and depth[start] <= bit:
                return [(start, stop, None)]
            cut = start + int(np.count_nonzero((low[start:stop] & mark) == 0))
            return [(start, cut, 0), (cut, stop, 1)]

        for a in parts(al, ah):
            for b in parts(bl, bh):
                if a[0] == a[1] or b[0] == b[1] or (al == bl and ah == bh and a[0] > b[0]):
                    continue
                more = wrong + (a[2] is not None and b[2] is not None and a[2] != b[2])
                if more <= budget:
                    pairs.append((*a[:2], *b[:2], bit + 1, more))
    return out


def _unit_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning links of one node pair: every fingerprint to the smallest of its component."""
    first = np.sort(rows.loc[rows["side"] == 0, "fp"].to_numpy().view(np.uint64))
    second = np.sort(rows.loc[rows["side"] == 1, "fp"].to_numpy().view(np.uint64))
    values = np.concatenate([first, second])
    parent = trie_components(values, len(first) if len(second) else None)
    linked = parent != np.arange(len(parent))
    return pd.DataFrame({"a": values[linked].view(np.int64), "b": values[parent[linked]].view(np.int64)})


def links(prints: DataFrame) -> DataFrame:
    """Spanning links (a, b) between the distinct numbers in ``prints`` (fp bigint)."""
    spark = prints.sparkSession
    bins = F.shiftrightunsigned("fp", 64 - TOP_BITS)
    histogram = np.zeros(1 << TOP_BITS, np.int64)
    for row in prints.groupBy(bins.alias("bin")).count().collect():  # at most 2 ** TOP_BITS rows
        histogram[row["bin"]] = row["count"]
    total = int(histogram.sum())
    if not total:
        return spark.createDataFrame([], "a bigint, b bigint")
    unit = min(max(LEAST_UNIT, total // NODES_WANTED), LARGEST_UNIT)
    nodes = top_nodes(histogram, unit)
    dealt: list[tuple[int, int, int]] = []
    for no, (i, j) in enumerate(node_pairs(nodes)):
        dealt += [(i, no, 0)] if i == j else [(i, no, 0), (j, no, 1)]
    starts = np.array([n[0] for n in nodes])
    of_bin = np.searchsorted(starts, np.arange(1 << TOP_BITS), side="right") - 1
    table = pd.DataFrame({"bin": np.arange(1 << TOP_BITS, dtype=np.int64), "node": of_bin})[histogram > 0]
    by_bin = spark.createDataFrame(table)  # at most 2 ** TOP_BITS rows of two numbers
    units = spark.createDataFrame(pd.DataFrame(dealt, columns=["node", "unit", "side"]))
    units = units.groupBy("node").agg(F.collect_list(F.struct("unit", "side")).alias("into"))
    if len(dealt) <= BROADCAST_PAIRS:
        units = F.broadcast(units)
    placed = (
        prints.withColumn("bin", bins)
        .join(F.broadcast(by_bin), "bin")
        .join(units, "node")
        .select("fp", F.explode("into").alias("to"))
        .select("fp", "to.unit", "to.side")
    )
    return placed.groupBy("unit").applyInPandas(_unit_links, "a bigint, b bigint")


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest of its component) of all nodes in ``edges`` (a, b), by star steps.

    A large-star step links every larger neighbour of a node to the smallest around it, a
    small-star step does so for the smaller ones; both keep components as they are. Each round
    is written to the shared folder; the rounds end when nothing changes.
    """
    spark = edges.sparkSession
    pairs = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    current = cut_lineage(pairs.distinct())
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(under, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = cut_lineage(small.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return spark.createDataFrame([], "node bigint, root bigint") if not state[0] else current.select(
                F.col("u").alias("node"), F.col("v").alias("root")
            )
        before = state


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, a hash of the text and the fingerprint of every row, written to the shared folder."""
    return cut_lineage(
        documents.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text")).alias("fp"))
    )


def components(prints: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """fp, root and component_id of every distinct fingerprint of ``prints`` (doc_id, fp).

    ``edges`` (a, b) link fingerprints in place of the trie join.
    """
    each = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = connected(links(each.select("fp")) if edges is None else edges)
    known = each.join(roots, each["fp"] == roots["node"], "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root")
    )
    known = cut_lineage(known)
    named = known.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return cut_lineage(known.join(named, "root").select("fp", "root", "component_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = fingerprints(documents)
    return prints.join(components(prints), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id, with its own columns.

    Of several rows with that id the one whose text hash is smallest stays; rows that are equal
    in id and text are folded.
    """
    with scratch(documents.sparkSession) as keep:
        prints = fingerprints(documents)
        chosen = keep(first_of_each(prints, components(prints)))
    return keep_chosen(documents, chosen)


def first_of_each(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """The document ``keep_one`` keeps of each component: chosen (doc_id, text_hash) and how many rows are it.

    From ``prints`` (doc_id, text_hash, fp) and ``classes`` (fp, root, component_id).
    """
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return prints.join(classes, "fp").filter(own).groupBy("root").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("chosen"), F.count("*").alias("rows")
    )


def keep_chosen(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``first_of_each`` has chosen."""
    key, mark = fresh(documents, "_text_hash"), fresh(documents, "_chosen")
    ids = chosen.select(F.struct("chosen.*", "rows").alias(mark))
    hashed = documents.withColumn(key, F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(ids[mark]["doc_id"]) & (hashed[key] == ids[mark]["text_hash"])
    joined = hashed.join(ids, same)
    single = joined.filter(F.col(mark)["rows"] == 1)
    several = joined.filter(F.col(mark)["rows"] > 1).dropDuplicates(["doc_id", key])
    return single.unionByName(several).select(*documents.columns)
