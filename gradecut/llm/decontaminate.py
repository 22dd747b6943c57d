"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased word sequences. A document overlaps a benchmark item where ``WINDOW``
(13) words in a row, laid against the item without gaps, agree in at least ``AGREE`` (11) places:
up to two words may be substituted. Seeds find the places: each of the fixed ``MASKS`` hashes the
six words under its ones and ignores those under its zeros, the hashes of the document's windows
are joined with those of the items, and around each hit the overlap is verified word by word.
The masks are lossless: whichever two of 13 places differ, one of them fits beside them, so the
result equals a comparison of all windows with all items.

Items of 8 to 12 words need four fifths of their words, rounded up, to agree over their whole
length, and are found by runs of words that such an overlap must contain; shorter items must
appear word for word. Items without words never match.

The items are hashed in blocks of at most about ``BLOCK_CHARS`` characters (one item if it is
longer); a block's index is shipped to the tasks and every document is held against every block,
whole texts throughout. Only one block's index is held at a time, by the driver and by the tasks: where
there are several blocks, each one's overlaps are written before the next is built, by the digest of the
text, and joined to the documents at the end. Where a text repeats a passage, only the first of the places with the same
words around them is verified: the others cannot give a better or earlier window. Null, empty and wordless texts
have no overlap, an empty table of documents gives an empty result and an empty benchmark no overlaps. Repeated rows are judged alike; items with equal texts are all reported, items with a
null id or text are ignored. Other columns of the inputs are ignored.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import arrow_column, cut_lineage, fresh

WINDOW = 13
AGREE = 11
MASKS = ("101110011", "110101011", "110010111")
LEAST_ITEM = 8
BLOCK_CHARS = 4_000_000
FILTER_BITS = 22
TOKENS_AT_ONCE = 1 << 20
FEW = 32

OVERLAPS = "array<struct<item_id:bigint,start:int,agree:int>>"

_WORD = re.compile(r"\w+")
_MIX = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) ^ (i << 40) | 1 for i in range(1, 64)], dtype=object) % 2**64
_MIX = _MIX.astype(np.uint64)


def words_of(text: str | None) -> list[str]:
    """Lower-case words."""
    return _WORD.findall(text.lower()) if text else []


def rule(length: int) -> tuple[int, int]:
    """Window and least agreement for an item of ``length`` words."""
    if length >= WINDOW:
        return WINDOW, AGREE
    if length >= LEAST_ITEM:
        return length, -(-4 * length // 5)
    return length, length


def masks_for(length: int) -> list[np.ndarray]:
    """Offsets under the ones of each mask that finds every overlap with an item of ``length`` words."""
    if length >= WINDOW:
        return [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
    window, agree = rule(length)
    run = -(-agree // (window - agree + 1))
    return [np.arange(run)]


@dataclass(frozen=True)
class SeedIndex:
    """Hashes of a block of items under each mask, sorted, with the places they come from."""

    ids: list[int]
    words: dict[str, int]
    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # offsets, hashes, items, places


def seed_hashes(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash under a mask at every start; the words' numbers are mixed by place."""
    count = len(words) - int(offsets[-1])
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k, o in enumerate(offsets):
        out += words[o : o + count] * _MIX[(7 * len(offsets) + k) % 63]
    out ^= out >> np.uint64(29)
    return out * _MIX[62]


def build_index(items: list[tuple[int, str]]) -> SeedIndex:
    """Index of one block of items (id, text)."""
    words: dict[str, int] = {}
    ids, coded = [], []
    for item, text in items:
        own = [words.setdefault(w, len(words) + 1) for w in words_of(text)]
        if own:
            ids.append(item)
            coded.append(np.array(own, np.uint64))
    lengths = np.array([len(c) for c in coded], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if coded else np.zeros(0, np.int64)
    by_mask: dict[tuple[int, ...], list] = {}
    for no, own in enumerate(coded):
        for offsets in masks_for(len(own)):
            hashes = seed_hashes(own, offsets)
            by_mask.setdefault(tuple(offsets.tolist()), []).append((hashes, np.full(len(hashes), no), np.arange(len(hashes))))
    seeds = []
    for offsets, found in sorted(by_mask.items()):
        hashes, items_of, places = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(hashes, kind="stable")
        seeds.append((np.array(offsets), hashes[order], items_of[order], places[order]))
    flat = np.concatenate(coded) if coded else np.zeros(0, np.uint64)
    return SeedIndex(ids, words, flat, starts, lengths, seeds)


def first_places(words: np.ndarray, at: np.ndarray, begins: np.ndarray, reach: int) -> np.ndarray:
    """Those of the positions ``at`` that are the first of their text with the same words up to ``reach`` around them."""
    steps = np.arange(-reach, reach + WINDOW)
    text = np.searchsorted(begins, at, "right")  # rising, as the positions are
    ends = np.append(np.flatnonzero(np.diff(text)) + 1, len(at))
    kept = np.ones(len(at), bool)
    for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
        if end - start >= FEW:
            where = at[start:end, None] + steps
            around = np.where((where >= 0) & (where < len(words)), words[np.clip(where, 0, len(words) - 1)], 0)
            kept[start:end] = False
            kept[start + np.unique(around, axis=0, return_index=True)[1]] = True
    return at[kept]


def _hits(words: np.ndarray, index: SeedIndex, offsets, hashes, items, places, known, begins):
    """Pairs of a word position and an item's place whose words agree under the mask."""
    found = seed_hashes(words, offsets)
    at = np.flatnonzero(known[(found >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    low = np.searchsorted(hashes, found[at], "left")
    many = np.searchsorted(hashes, found[at], "right") - low
    at, low, many = at[many > 0], low[many > 0], many[many > 0]
    if begins is not None and len(at) >= FEW:
        first = np.isin(at, first_places(words, at, begins, max(WINDOW - 1, int(offsets[-1]))))
        at, low, many = at[first], low[first], many[first]
    position = np.repeat(at, many)
    nth = np.arange(len(position)) - np.repeat(np.cumsum(many) - many, many)
    entry = np.repeat(low, many) + nth
    return position, items[entry], places[entry]


def overlaps_in(
    words: np.ndarray, index: SeedIndex, filters: list[np.ndarray], begins: np.ndarray | None = None
) -> list[tuple[int, int, int]]:
    """Item number, first word and agreement of every verified overlap window, best first per item and diagonal.

    ``words`` may hold several texts with at least ``WINDOW`` zeros between them; where ``begins`` says
    where they begin, places with the same words around them are looked at once a text.
    """
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for (offsets, hashes, items, places), known in zip(index.seeds, filters, strict=True):
        position, item, place = _hits(words, index, offsets, hashes, items, places, known, begins)
        if not len(position):
            continue
        for length in np.unique(index.lengths[item]) if index.lengths[item].min() < WINDOW else [WINDOW]:
            mine = index.lengths[item] == length if length < WINDOW else index.lengths[item] >= WINDOW
            window, agree = rule(int(length))
            p, it, pl = position[mine], item[mine], place[mine]
            reach = max(window - 1, int(offsets[-1]))
            steps = np.arange(-reach, reach + window)
            for s in range(0, len(p), 1 << 14):
                pp, ii, qq = p[s : s + (1 << 14)], it[s : s + (1 << 14)], pl[s : s + (1 << 14)]
                here, there = pp[:, None] + steps, qq[:, None] + steps
                inside = (here >= 0) & (here < len(words)) & (there >= 0) & (there < index.lengths[ii][:, None])
                mine_w = words[np.clip(here, 0, len(words) - 1)]
                item_w = index.flat[np.minimum(index.starts[ii][:, None] + np.maximum(there, 0), len(index.flat) - 1)]
                same = (mine_w == item_w) & inside & (mine_w > 0)
                sums = np.cumsum(np.hstack([np.zeros((len(pp), 1), np.int64), same]), axis=1)
                room = np.cumsum(np.hstack([np.zeros((len(pp), 1), np.int64), inside]), axis=1)
                within = (sums[:, window:] - sums[:, :-window]) * ((room[:, window:] - room[:, :-window]) == window)
                best = within.argmax(axis=1)
                top = within[np.arange(len(pp)), best]
                for k in np.flatnonzero(top >= agree):
                    key = (int(ii[k]), int(pp[k] - qq[k]))
                    candidate = (int(top[k]), -int(here[k, best[k]]))
                    if key not in out or candidate > out[key]:
                        out[key] = candidate
    return [(item, -start, top) for (item, _), (top, start) in out.items()]


def seed_filters(index: SeedIndex) -> list[np.ndarray]:
    """For each mask, which leading hash bits occur at all."""
    out = []
    for _, hashes, _, _ in index.seeds:
        known = np.zeros(1 << FILTER_BITS, bool)
        known[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        out.append(known)
    return out


def overlaps_of(texts: list[str | None], index: SeedIndex, filters: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(item id, first word, agreement) of each text, the best window of each item, by item id."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    gap, get = [0] * WINDOW, index.words.get
    coded: list[int] = []
    begins: list[int] = []
    owners: list[int] = []

    def flush() -> None:
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for item, start, top in overlaps_in(np.array(coded, np.uint64), index, filters, np.array(begins)):
            nth = int(np.searchsorted(begins, start, "right")) - 1
            key = (owners[nth], index.ids[item])
            candidate = (top, -(start - begins[nth]))
            if key not in found or candidate > found[key]:
                found[key] = candidate
        for (owner, item), (top, start) in sorted(found.items()):
            out[owner].append((item, -start, top))

    for no, text in enumerate(texts):
        begins.append(len(coded))
        owners.append(no)
        coded.extend([get(w, 0) for w in words_of(text)])
        coded.extend(gap)
        if len(coded) > TOKENS_AT_ONCE:
            flush()
            coded, begins, owners = [], [], []
    if coded:
        flush()
    return out


def item_blocks(benchmark: DataFrame) -> Iterator[SeedIndex]:
    """Indexes of the blocks of ``benchmark`` (item_id, text), each collected when it is asked for."""
    sound = benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(block_count(benchmark)))
    for no in range(block_count(benchmark)):
        rows = sound.filter(block == no).distinct().collect()
        if rows:
            yield build_index(sorted((r["item_id"], r["text"]) for r in rows))


def block_count(benchmark: DataFrame) -> int:
    """How many blocks the items make."""
    chars = benchmark.agg(F.sum(F.char_length("text"))).first()[0] or 0
    return max(1, -(-chars // BLOCK_CHARS))


def overlaps(text: Column, index: SeedIndex, sent) -> Column:
    """Overlaps of the whole text with a block's items, by item, as one array column. ``sent`` is its broadcast."""

    def make():
        own = sent.value
        filters = seed_filters(own)

        def apply(batch: pa.Array) -> pa.Array:
            found = overlaps_of(batch.to_pylist(), own, filters)
            flat = [x for f in found for x in f]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            columns = [pa.array([x[i] for x in flat], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["item_id", "start", "agree"]))

        return apply

    return arrow_column(make, OVERLAPS)(text)


def with_overlaps(documents: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """The documents with a column of their overlaps."""
    context = documents.sparkSession.sparkContext
    none = F.array().cast(OVERLAPS)
    if block_count(benchmark) == 1:
        index = next(item_blocks(benchmark), None)
        found = none if index is None else F.array_sort(overlaps(F.col("text"), index, context.broadcast(index)))
        return documents.withColumn(name, found)
    parts = []
    for index in item_blocks(benchmark):
        sent = context.broadcast(index)
        part = documents.select(F.md5("text").alias("_digest"), overlaps(F.col("text"), index, sent).alias("_part"))
        once = part.filter(F.size("_part") > 0).groupBy("_digest").agg(F.first("_part").alias("_part"))
        parts.append(cut_lineage(once))
        sent.destroy()
    key = fresh(documents, "_digest")
    if not parts:
        return documents.withColumn(name, none)
    whole = reduce(DataFrame.unionByName, parts).groupBy(F.col("_digest").alias(key)).agg(
        F.array_sort(F.flatten(F.collect_list("_part"))).alias(name)  # one list of each block
    )
    joined = documents.withColumn(key, F.md5("text")).join(whole, key, "left")
    return joined.select(*documents.columns, F.coalesce(F.col(name), none).alias(name))


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated (0 or 1) and the overlaps of every document, the best of each item."""
    found = with_overlaps(documents.select("doc_id", "text"), benchmark, "overlaps")
    return found.select("doc_id", (F.size("overlaps") > 0).cast("int").alias("contaminated"), "overlaps")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any overlap, with their own columns."""
    mark = fresh(documents, "_overlaps")
    found = with_overlaps(documents, benchmark, mark)
    return found.filter(F.size(mark) == 0).select(*documents.columns)
