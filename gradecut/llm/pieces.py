"""SentencePiece encoding and decoding with exact n-best segmentation.

A text, with one space put before it, is a lattice: an edge for every vocabulary piece (spaces
stand for the vocabulary's word marks) and, for a character that is no piece, one edge that
spells its UTF-8 bytes in byte pieces. A segmentation's score is the sum of its pieces'.
A forward Viterbi pass gives the best score of every prefix; these are exact heuristics for an
A-star search that runs backward from the end, so its complete paths come out best first and the
first n are the n best.

No piece but runs of spaces holds a space behind another character, so every place where a space
follows something else cuts the lattice, and so do line ends and tabs where they are in no piece.
Each stretch between cuts ("word") is searched on its
own, and the text's n best are merged from them exactly: a path among the n best leaves the best
one only in words whose runner-up costs least, n - 1 of them.
A word's runner-up cost is already known after its forward pass (the smallest loss by entering a
node of the best path over another edge), so the search runs only where its answer matters.

Scores: ``"zipf"`` takes a piece of rank r as probable as 1 / r, which suits vocabularies
whose stored scores are merge ranks; ``"stored"`` takes the stored scores, which suits
unigram vocabularies. Among equals the best segmentation is the one with the longest last piece,
the others follow by their ids (where more are equal than wanted, the search takes any), and equal losses go to the earlier word.

Null texts give null, empty texts no ids and the score 0. Any other text decodes to itself
whatever it holds, word marks and control strings included (lone surrogates cannot occur in a
Spark string). Repeated rows are encoded alike; other columns of the input are ignored.
"""

import heapq
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import arrow_column

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 3
MARK = "▁"
BYTE_PENALTY = 10.0
CACHED_WORDS = 20_000

TOGETHER = 24
TOGETHER_CHARS = 40
CHARS_AT_ONCE = 1_500_000
IDS_AT_ONCE = 300_000
WORDS_AT_ONCE = 4_096
SLOT_BITS = 20
HASH_BASE = 1_000_003

EDIT = "struct<first:int,many:int,ids:array<int>>"
RESULT = f"struct<ids:array<int>,scores:array<double>,alternatives:array<array<{EDIT}>>,exact:boolean>"
EDITS = pa.list_(pa.list_(pa.struct([("first", pa.int32()), ("many", pa.int32()), ("ids", pa.list_(pa.int32()))])))

CUTS = "\n\r\t"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with spaces for word marks, the score of each, and the ids of the 256 bytes."""

    pieces: list[str]
    scores: list[float]
    bytes_at: list[int]


def load_vocabulary(model_file: str = MODEL, scoring: str = "zipf") -> Vocabulary:
    """Read a SentencePiece model with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    bytes_at = [0] * 256
    pieces, stored, plain = [""] * size, [0.0] * size, []
    for i in range(size):
        if model.is_byte(i):
            bytes_at[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[i] = model.id_to_piece(i).replace(MARK, " ")
            stored[i] = model.get_score(i)
            plain.append(i)
    if scoring == "zipf":
        norm = math.log(sum(1 / r for r in range(1, len(plain) + 1)))
        scores = [0.0] * size
        for rank, i in enumerate(plain, 1):
            scores[i] = -math.log(rank) - norm
    else:
        scores = stored
    least = min(scores[i] for i in plain) - BYTE_PENALTY
    for i in bytes_at:
        scores[i] = least
    return Vocabulary(pieces, scores, bytes_at)


def edited(ids: list[int], edits: list[tuple[int, int, list[int]]]) -> list[int]:
    """``ids`` with each (first, how many) replaced by new ids."""
    out, at = [], 0
    for first, many, new in edits:
        out += ids[at:first] + new
        at = first + many
    return out + ids[at:]


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of ragged ranges, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceTable:
    """Vectorised lookup of substrings by their polynomial hash."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        ids = [i for i, p in enumerate(vocabulary.pieces) if p]
        hashes = np.array([self._hash(vocabulary.pieces[i]) for i in ids], np.uint64)
        self.longest = max((len(vocabulary.pieces[i]) for i in ids), default=1)
        self._scores = np.append(np.array([vocabulary.scores[i] for i in ids]), -np.inf)
        self._ids = np.array([*ids, -1], np.int32)
        self._sizes = np.array([*(len(vocabulary.pieces[i]) for i in ids), 0], np.int32)
        self._hashes = np.append(hashes, np.uint64(0))
        slots, left = [], np.arange(len(ids))
        for spread in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            if not len(left):
                break
            table = np.full(1 << SLOT_BITS, len(ids), np.int32)
            at = self._slot(hashes[left], spread)
            table[at] = left
            slots.append((spread, table))
            left = left[table[at] != left]
        if len(left):
            raise ValueError("the vocabulary is too large for its lookup tables")
        self._slots = slots

    @staticmethod
    def _hash(piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * HASH_BASE + ord(c) + 1) % 2**64
        return out

    @staticmethod
    def _slot(hashes: np.ndarray, spread: int) -> np.ndarray:
        mixed = hashes ^ (hashes >> np.uint64(31))
        return ((mixed * np.uint64(spread)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def extend(self, hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return hashes * np.uint64(HASH_BASE) + codes

    def find(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores (-inf for no piece) and ids of substrings of one length, told by length and 64-bit hash."""
        none = len(self._hashes) - 1
        out = np.full(len(hashes), none, np.int32)
        for spread, table in self._slots:
            found = table[self._slot(hashes, spread)]
            out = np.where((out == none) & (self._hashes[found] == hashes) & (self._sizes[found] == size), found, out)
        return self._scores[out], self._ids[out]


class Segmenter:
    """Encodes and decodes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._vocabulary = vocabulary
        self._edges = {p: (vocabulary.scores[i], i) for i, p in enumerate(vocabulary.pieces) if p}
        self._longest = max(map(len, self._edges), default=1)
        raw = [p.encode("utf-8", "surrogatepass") for p in vocabulary.pieces]
        for byte, i in enumerate(vocabulary.bytes_at):
            raw[i] = bytes([byte])
        self._bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._byte_counts = np.array([len(r) for r in raw], np.int64)
        self._byte_begins = np.cumsum(self._byte_counts) - self._byte_counts
        self._table = PieceTable(vocabulary)
        alone = "".join(c for c in CUTS if not any(c in p for p in vocabulary.pieces))
        self._stretches = re.compile(f" *[^ {alone}]+| +|[{alone}]+" if alone else " *[^ ]+| +").findall
        self._ranked: dict[tuple[str, int], list] = {}

    def _spelled(self, char: str) -> tuple[int, ...]:
        return tuple(self._vocabulary.bytes_at[b] for b in char.encode("utf-8", "surrogatepass"))

    def _incoming(self, word: str, stop: int) -> list[tuple[float, tuple[int, ...], int]]:
        """(score, ids, start) of the edges that end at ``stop``."""
        out = []
        for start in range(max(0, stop - self._longest), stop):
            if edge := self._edges.get(word[start:stop]):
                out.append((edge[0], (edge[1],), start))
        if word[stop - 1] not in self._edges:
            ids = self._spelled(word[stop - 1])
            out.append((self._vocabulary.scores[ids[0]] * len(ids), ids, stop - 1))
        return out

    def _forward(self, word: str) -> tuple[tuple[int, ...], float, float]:
        """Ids and score of the best segmentation, and what the runner-up loses."""
        n = len(word)
        best, second, via = [0.0], [-math.inf], [((), 0)]
        for stop in range(1, n + 1):
            top = runner = -math.inf
            edge = ((), 0)
            for score, ids, start in self._incoming(word, stop):
                score += best[start]
                if score > top:
                    runner, top, edge = top, score, (ids, start)
                elif score > runner:
                    runner = score
            best.append(top)
            second.append(runner)
            via.append(edge)
        back: list[tuple[int, ...]] = []
        stop, loss = n, math.inf
        while stop:
            loss = min(loss, best[stop] - second[stop])
            ids, stop = via[stop]
            back.append(ids)
        return tuple(i for ids in reversed(back) for i in ids), best[n], loss

    def _forward_many(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """``_forward`` of words of one length together.

        Numbers of the words that are made of pieces alone, how many ids each has, their ids one
        after another, scores and losses.
        """
        table, n, count = self._table, len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, n)
        codes = np.ascontiguousarray(codes.T).astype(np.uint64) + np.uint64(1)
        widest = min(n, table.longest)
        scores = np.full((widest, n, count), -np.inf)
        ids = np.full((widest, n, count), -1, np.int32)
        hashes = np.zeros((n, count), np.uint64)
        for size in range(1, widest + 1):
            starts = n - size + 1
            hashes = table.extend(hashes[:starts], codes[size - 1 :])
            score, found = table.find(hashes.ravel(), size)
            scores[size - 1, :starts] = score.reshape(starts, count)
            ids[size - 1, :starts] = found.reshape(starts, count)
        best = np.zeros((n + 1, count))
        loss_at = np.full((n + 1, count), np.inf)
        sizes = np.zeros((n + 1, count), np.int64)
        for stop in range(1, n + 1):
            reach = min(stop, widest)
            # rows from the longest piece to the shortest, so that the longest wins among equals
            ways = np.stack([best[stop - size] + scores[size - 1, stop - size] for size in range(reach, 0, -1)])
            first = ways.argmax(axis=0)
            sizes[stop] = reach - first
            best[stop] = ways[first, np.arange(count)]
            if reach > 1:
                ways[first, np.arange(count)] = -np.inf
                with np.errstate(invalid="ignore"):  # words with a character that is no piece go the plain way
                    loss_at[stop] = best[stop] - ways.max(axis=0)
        plain = np.isfinite(scores[0]).all(axis=0)
        word = np.flatnonzero(plain)
        stop = np.full(len(word), n)
        back = np.full((n, len(word)), -1, np.int32)
        loss = np.full(len(word), np.inf)
        used = np.zeros(len(word), np.int64)
        row = n - 1
        while (stop > 0).any():
            on = stop > 0
            loss[on] = np.minimum(loss[on], loss_at[stop[on], word[on]])
            size = sizes[stop[on], word[on]]
            stop[on] -= size
            back[row, on] = ids[size - 1, stop[on], word[on]]
            used += on
            row -= 1
        turned = back[::-1].T  # a word's ids from its last to its first, then -1
        turned = turned[np.arange(len(word))[:, None], np.maximum(used[:, None] - 1 - np.arange(n), 0)]
        return word, used, turned[np.arange(n) < used[:, None]], best[n, word], loss

    def forward(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward passes of distinct words: where each one's ids begin, the ids, scores and losses."""
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(len(word), []).append(i)
        counts = np.zeros(len(words), np.int64)
        scores, losses = np.zeros(len(words)), np.zeros(len(words))
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # words and their ids, one after another
        for size, group in by_size.items():
            plainly = np.array(group)
            if size <= TOGETHER_CHARS and len(group) >= TOGETHER:
                for at in range(0, len(group), WORDS_AT_ONCE):
                    own = np.array(group[at : at + WORDS_AT_ONCE])
                    done, used, ids, total, loss = self._forward_many([words[i] for i in own])
                    counts[own[done]], scores[own[done]], losses[own[done]] = used, total, loss
                    parts.append((own[done], ids))
                plainly = plainly[counts[plainly] == 0]
            for i in plainly.tolist():
                ids, scores[i], losses[i] = self._forward(words[i])
                counts[i] = len(ids)
                parts.append((np.array([i]), np.array(ids, np.int32)))
        begins = np.concatenate(([0], np.cumsum(counts)))
        flat = np.zeros(int(begins[-1]), np.int32)
        for own, ids in parts:
            flat[_ranges(begins[own], counts[own])] = ids
        return begins, flat, scores, losses

    def n_best(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one stretch, by A-star from its end with prefix scores as heuristics.

        A heap entry points to the step it was reached by, and ids are put together for finished
        paths only. A place is left at most n times, as n better ways to it make n better paths,
        so that memory grows with the stretch and not with its square.
        """
        size = len(word)
        best = [0.0] + [-math.inf] * size
        for stop in range(1, size + 1):
            best[stop] = max(best[start] + score for score, _, start in self._incoming(word, stop))
        steps: list[tuple[tuple[int, ...], int]] = []  # ids of an edge and the step after it
        left: dict[int, int] = {}
        heap = [(-best[size], size, 0, 0.0, (), -1)]
        pushed = 0
        out = []
        while heap and len(out) < n:
            total, stop, _, behind, edge, after = heapq.heappop(heap)
            if stop == 0:
                ids = list(edge)
                while after >= 0:
                    edge, after = steps[after]
                    ids += edge
                out.append((-total, tuple(ids)))
                continue
            left[stop] = left.get(stop, 0) + 1
            if left[stop] > n:
                continue
            steps.append((edge, after))
            for score, edge, start in self._incoming(word, stop):
                pushed += 1
                heapq.heappush(heap, (-(best[start] + score + behind), start, pushed, score + behind, edge, len(steps) - 1))
        return sorted(out, key=lambda found: (-found[0], found[1]))

    def encode_batch(self, texts: list[str], n: int = NBEST) -> tuple[np.ndarray, np.ndarray, list, list]:
        """Where each text's best ids end, the ids, and of each text the n best scores and the edits
        that make the others."""
        split = [self._stretches(" " + t) if t else [] for t in texts]
        every = [w for own in split for w in own]
        words = list(dict.fromkeys(every))
        number = dict(zip(words, range(len(words)), strict=True))
        begins, flat, word_scores, losses = self.forward(words)
        token = np.fromiter(map(number.__getitem__, every), np.int64, len(every))
        counts = np.diff(begins)[token]
        ids = flat[_ranges(begins[token], counts)]
        starts = np.cumsum([0, *(len(own) for own in split)])
        reached = np.concatenate(([0], np.cumsum(counts)))
        loss, score = losses[token], word_scores[token]
        scores, edits = [], []
        for own, at, end in zip(split, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            scores.append([math.fsum(score[at:end])])
            edits.append([])
            if n > 1 and own:
                self._runners_up(own, loss[at:end].copy(), n, scores[-1], edits[-1])
                for one in edits[-1]:
                    one[:] = [(int(reached[at + i] - reached[at]), int(counts[at + i]), new) for i, new in one]
        return reached[starts[1:]], ids, scores, edits

    def encode(self, text: str, n: int = NBEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text, each with its score, best first."""
        _, ids, scores, edits = self.encode_batch([text], n)
        best = ids.tolist()
        return list(zip(scores[0], [best, *(edited(best, e) for e in edits[0])], strict=True))

    def _ranked_word(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """``n_best`` with the segmentation of the forward pass first, also among equals."""
        found = self._ranked.get((word, n))
        if found is None:
            ids, score, _ = self._forward(word)
            found = [(score, ids), *[f for f in self.n_best(word, n) if f[1] != ids][: n - 1]]
            if len(word) <= TOGETHER_CHARS:
                if len(self._ranked) >= CACHED_WORDS:
                    self._ranked.clear()
                self._ranked[word, n] = found
        return found

    def _runners_up(self, words, losses, n, scores, edits) -> None:
        """Add the second to the n-th best segmentation, as (place of a word, its new ids)."""
        places = []
        for _ in range(min(n - 1, len(losses))):
            place = int(losses.argmin())
            if losses[place] == math.inf:
                break
            losses[place] = math.inf
            places.append(place)
        places.sort()
        choices = [self._ranked_word(words[i], n) for i in places]
        sums = [(0.0, ())]
        for found in choices:
            grown = [(loss + found[0][0] - s, (*picks, k)) for loss, picks in sums for k, (s, _) in enumerate(found)]
            sums = heapq.nsmallest(n, grown)
        for loss, picks in sums[1:]:
            scores.append(scores[0] - loss)
            edits.append([(place, list(choices[j][k][1])) for j, (place, k) in enumerate(zip(places, picks, strict=True)) if k])

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text, from the ids of all and how many each has."""
        parts = []
        for at in range(0, len(ids), IDS_AT_ONCE):
            part = ids[at : at + IDS_AT_ONCE]
            parts.append(self._bytes[_ranges(self._byte_begins[part], self._byte_counts[part])].tobytes())
        raw = b"".join(parts)
        reached = np.concatenate(([0], np.cumsum(self._byte_counts[ids])))
        ends = reached[np.cumsum(counts)].tolist()
        # the first byte is the space that was put before the text
        return [raw[start + 1 : end] for start, end in zip([0, *ends][:-1], ends, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded to ``ids``."""
        return self.decode_batch(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def encode(text: Column, vocabulary: Vocabulary, spark, n: int = NBEST) -> Column:
    """Ids of the best segmentation, the scores of the n best, the others as edits of the best, and
    whether the ids decode to the text (they are decoded to tell)."""
    sent = spark.sparkContext.broadcast(vocabulary)

    def make():
        segmenter = _segmenter(sent.value)

        def chunks(batch: pa.Array):
            texts: list[str | None] = []
            size = 0
            for text in batch:
                texts.append(text.as_py())
                size += len(texts[-1] or "")
                if size > CHARS_AT_ONCE:
                    yield texts
                    texts, size = [], 0
            if texts:
                yield texts

        def apply(batch: pa.Array) -> pa.Array:
            flat, ends, scores, score_ends, others, exact = [], [np.zeros(1, np.int64)], [], [0], [], []
            for texts in chunks(batch):
                stops, ids, found, edits = segmenter.encode_batch([t or "" for t in texts], n)
                back = segmenter.decode_batch(ids, np.diff(stops, prepend=0))
                exact += [b == (t or "").encode("utf-8", "surrogatepass") for b, t in zip(back, texts, strict=True)]
                flat.append(ids)
                ends.append(ends[-1][-1] + stops)
                for one in found:
                    scores += one
                    score_ends.append(len(scores))
                others += [[[{"first": f, "many": m, "ids": i} for f, m, i in one] for one in each] for each in edits]
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            return pa.StructArray.from_arrays(
                [
                    lists(np.concatenate(ends), pa.array(np.concatenate(flat))),
                    lists(score_ends, pa.array(scores, pa.float64())),
                    pa.array(others, EDITS),
                    pa.array(exact),
                ],
                ["ids", "scores", "alternatives", "exact"],
                mask=batch.is_null(),
            )

        return apply

    return arrow_column(make, RESULT)(text)


def decode(ids: Column, vocabulary: Vocabulary, spark) -> Column:
    """Text of an array of ids."""
    sent = spark.sparkContext.broadcast(vocabulary)

    def make():
        segmenter = _segmenter(sent.value)

        def apply(batch: pa.Array) -> pa.Array:
            texts: list[str | None] = []
            for ids in batch:
                texts.append(segmenter.decode(ids.values.to_numpy()) if ids.is_valid else None)
            return pa.array(texts, pa.string())

        return apply

    return arrow_column(make, "string")(ids)


_KEPT: dict = {}


def _segmenter(vocabulary: Vocabulary) -> Segmenter:
    """The worker's segmenter, so that the tasks of one worker share its cache."""
    key = (len(vocabulary.pieces), hash(tuple(vocabulary.pieces)), hash(tuple(vocabulary.scores)))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Segmenter(vocabulary)
    return _KEPT[key]


def tokenize(documents: DataFrame, vocabulary: Vocabulary, n: int = NBEST) -> DataFrame:
    """doc_id, ids of the best segmentation, scores of the n best, the others as edits of the best, and
    round_trip: whether the ids decode to the text (null for a null text)."""
    found = documents.select("doc_id", encode(F.col("text"), vocabulary, documents.sparkSession, n).alias("found"))
    return found.select(
        "doc_id", "found.ids", "found.scores", "found.alternatives", F.col("found.exact").alias("round_trip")
    )
