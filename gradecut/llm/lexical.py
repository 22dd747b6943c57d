"""Exact ranked lexical search by the best position algorithm over impact lists.

Documents are ranked for a table of items by the sum, over an item's terms with repeats, of the
term's weight times its impact in the document. All of it is whole numbers but the weight's
logarithm; see ``impacts`` and ``weights``.

One pass cuts every text into terms and keeps, for each document, its length and the counts of the
items' terms. From these come the statistics of all documents: how many have a term, all their terms, and
each term's documents. Then every task takes its documents in shards of about ``SHARD`` counts and
builds, for each term, a list of the shard's documents by falling impact. For an item its terms'
lists are read from the top, all to the same depth. A document met for the first time is scored by
direct access to the item's other lists, and every place it holds there counts as seen. The best
position of a list is the last one before its first unseen place; no document that has not been met
can score more than the weighted sum of the impacts at the best positions. Reading stops once that
sum is strictly below the k-th best score so far (equal ones may still win by their id), or when
every list is seen to its end. The k best of one shard are the start for a task's next, so later shards
stop sooner. A task hands on k documents for each item; these are merged by ranks inside parts of the
tasks first, then over all.

Items are dealt to blocks of about ``BLOCK`` terms with repeats; a block's items and the weights of its terms are
shipped to the tasks, so what is shipped has a bound, and documents are read once for each block. Nothing is shuffled
but the terms' counts and the k best.

Null and empty texts have no term: such documents do not count in N, such items find nothing.
Every row is a document of its own, repeated ids too, and every benchmark row an item of its own.
Documents with a null id count in the statistics but are not ranked. Ties go to the smaller id. Empty
tables give an empty result. Other columns are ignored.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradecut.llm.common import arrow_column, cut_lineage

K = 10
BLOCK = 200_000
SHARD = 500_000
FIRST_DEPTH = 16
PARTS = 64

# letters of the terms: ASCII digits and letters, the capitals made small, and every byte beyond ASCII
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text, in order, with repeats."""
    return text.translate(_TERM).split() if text else []


def length_part(n: int, count: int, total: int) -> int:
    """How a document's length weighs: 100 - 75 + (75 * n * count) div total."""
    return 25 + (75 * n * count) // total


def weight(df: int, count: int) -> int:
    """Weight of a term that ``df`` of ``count`` documents hold."""
    return math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Items:
    """A block of items: ids and, for each, its terms as numbers with their repeats."""

    ids: list
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: dict[bytes, int]


def number_items(rows: list[tuple]) -> Items:
    """Items (id, text) with their terms numbered."""
    vocabulary: dict[bytes, int] = {}
    ids, terms, repeats = [], [], []
    for item, text in rows:
        counts = Counter(terms_of(text.encode() if text is not None else None))
        ids.append(item)
        terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int64))
        repeats.append(np.array(list(counts.values()), np.int64))
    return Items(ids, terms, repeats, vocabulary)


def counts_of(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, how many terms the text has, and number and count of those in ``vocabulary``."""
    shipped = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        known = shipped.value

        def apply(batch: pa.Array) -> pa.Array:
            lengths, numbers, counts, ends = [], [], [], [0]
            for text in batch.cast(pa.binary()):
                terms = terms_of(text.as_py())
                lengths.append(len(terms))
                for term, count in Counter(terms).items():
                    if (number := known.get(term)) is not None:
                        numbers.append(number)
                        counts.append(count)
                ends.append(len(numbers))
            ends = pa.array(ends, pa.int32())
            return pa.StructArray.from_arrays(
                [
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                ],
                ["n", "terms", "counts"],
            )

        return apply

    found = arrow_column(make, "n bigint, terms array<int>, counts array<bigint>")(F.col("text"))
    return documents.select("doc_id", found.alias("c")).select("doc_id", "c.*")


class Shard:
    """Impact lists of some documents: for each term its documents by falling impact."""

    def __init__(self, doc_ids: np.ndarray, norms: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        self.doc_ids = doc_ids
        docs = np.repeat(np.arange(len(doc_ids)), np.diff(ends))
        impact = (1_000_000_000 * counts) // (1000 * counts + 8 * norms[docs])
        by_doc = np.lexsort((docs, terms))
        by_impact = np.lexsort((docs, -impact, terms))
        place = np.empty(len(terms), np.int64)
        place[by_impact] = np.arange(len(terms))
        self._terms, self._starts = np.unique(terms[by_doc], return_index=True)
        self._stops = np.append(self._starts[1:], len(terms))
        self._docs, self._values = docs[by_doc], impact[by_doc]
        self._place = place[by_doc] - np.repeat(self._starts, self._stops - self._starts)
        self._top_docs, self._top_values = docs[by_impact], impact[by_impact]

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple]:
        """(weight, docs, values and places by document, docs and values by impact) of each term found here."""
        found = []
        at = np.searchsorted(self._terms, terms)
        for i, term, w in zip(at.tolist(), terms.tolist(), weights.tolist(), strict=True):
            if w > 0 and i < len(self._terms) and self._terms[i] == term:
                part = slice(self._starts[i], self._stops[i])
                found.append(
                    (w, self._docs[part], self._values[part], self._place[part], self._top_docs[part], self._top_values[part])
                )
        return found


class Best:
    """The k best (score, doc_id) of an item; equal scores by the smaller id."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(scores) > self.k:
            floor = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= floor], ids[scores >= floor]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    @property
    def floor(self) -> int:
        """The k-th best score, 0 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0


def search_shard(shard: Shard, lists: list[tuple], best: Best) -> tuple[int, int]:
    """Let ``best`` meet a shard's documents. Returns places read in order and documents scored."""
    met = np.zeros(len(shard.doc_ids), bool)
    seen = [np.zeros(len(one[1]), bool) for one in lists]
    best_at = [0] * len(lists)  # places seen without a gap
    depth, read, scored = 0, 0, 0
    step = FIRST_DEPTH
    while True:
        left = [i for i, one in enumerate(lists) if best_at[i] < len(one[1])]
        bound = sum(lists[i][0] * int(lists[i][5][best_at[i] - 1 if best_at[i] else 0]) for i in left)
        if not left or (best.floor > 0 and bound < best.floor):
            return read, scored
        new = []
        for i in left:
            top = lists[i][4][depth : depth + step]
            read += len(top)
            new.append(top[~met[top]])
        fresh = np.unique(np.concatenate(new))
        met[fresh] = True
        scored += len(fresh)
        scores = np.zeros(len(fresh), np.int64)
        for i, (w, docs, values, places, _, _) in enumerate(lists):
            if len(fresh):  # direct access: where the new documents stand in this list
                at = np.searchsorted(docs, fresh)
                at[at == len(docs)] = 0
                hit = docs[at] == fresh
                scores[hit] += w * values[at[hit]]
                seen[i][places[at[hit]]] = True
            rest = seen[i][best_at[i] :]
            gap = int(rest.argmin()) if len(rest) else 0
            best_at[i] += len(rest) if len(rest) and rest[gap] else gap
        best.add(scores[scores > 0], shard.doc_ids[fresh[scores > 0]])
        depth += step
        step *= 2


def _shards(batches: Iterator[pa.RecordBatch], count: int, total: int) -> Iterator[Shard]:
    """Documents with terms, in shards of about ``SHARD`` counts."""
    held, size = [], 0

    def build() -> Shard:
        ends = np.cumsum([0, *(len(t) for _, _, t, _ in held)])
        norms = np.array([length_part(n, count, total) for _, n, _, _ in held], np.int64)
        terms = np.concatenate([t for _, _, t, _ in held]).astype(np.int64)
        return Shard(np.array([d for d, _, _, _ in held], np.int64), norms, ends, terms, np.concatenate([c for _, _, _, c in held]))

    for batch in batches:
        terms, counts = batch.column("terms"), batch.column("counts")
        starts = terms.offsets.to_numpy()
        numbers, values = terms.values.to_numpy(), counts.values.to_numpy()
        for i, (doc_id, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), strict=True)):
            part = slice(starts[i], starts[i + 1])
            # copies, as a view would keep the whole batch
            held.append((doc_id, n, numbers[part].copy(), values[part].copy()))
            size += part.stop - part.start
            if size >= SHARD:
                yield build()
                held, size = [], 0
    if held:
        yield build()


def search_block(counted: DataFrame, items: Items, k: int) -> DataFrame:
    """item (its place in the block), doc_id and score: the k best of each task for each item."""
    count, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(items.vocabulary) + 1, np.int64)
    for term, df in held:
        weights[term] = weight(df, count)
    shipped = counted.sparkSession.sparkContext.broadcast((items.terms, items.repeats, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, repeats, weights = shipped.value
        best = [Best(k) for _ in terms]
        for shard in _shards(batches, count, total):
            for t, r, b in zip(terms, repeats, best, strict=True):
                lists = shard.lists(t, weights[t] * r)
                if lists:
                    search_shard(shard, lists, b)
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            columns = [np.repeat(np.arange(len(best)), sizes), *(np.concatenate([getattr(b, c) for b in best]) for c in ("ids", "scores"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    ranked = counted.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
    return ranked.select(F.col("doc_id").cast("bigint"), "n", "terms", "counts").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank, first inside parts, then over all."""
    order = (F.desc("score"), "doc_id")
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    first = Window.partitionBy("item", "part").orderBy(*order)
    some = dealt.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("rank")
    last = Window.partitionBy("item").orderBy(*order)
    return some.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).drop("part")


def blocks_of(benchmark: DataFrame, most: int = BLOCK) -> Iterator[list[tuple]]:
    """Items (id, text) in blocks of about ``most`` terms (no more than half an item's bytes), one block after the other."""
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / 2)
    blocks = max(1, math.ceil((benchmark.agg(size).first()[0] or 0) / most))
    for b in range(blocks):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [tuple(r) for r in part.select("item_id", "text").collect()]


def search(documents: DataFrame, benchmark: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of every item."""
    spark = documents.sparkSession
    kind = benchmark.schema["item_id"].dataType.simpleString()
    results = []
    for rows in blocks_of(benchmark):
        items = number_items(rows)
        if not items.vocabulary:
            continue
        counted = cut_lineage(counts_of(documents, items.vocabulary))
        found = best_of(search_block(counted, items, k), k)
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item bigint, item_id {kind}")
        results.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    whole = results[0]
    for other in results[1:]:
        whole = whole.unionByName(other)
    return whole
