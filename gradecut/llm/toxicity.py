"""Toxicity from document labels: multiple-instance learning with a noisy-or over sentences.

A document is a bag of sentences. A sentence is toxic with probability
``sigmoid(bias + sum of the weights of its distinct words and word beginnings)``, a document with
probability ``1 - prod(1 - p(sentence))``. Only documents carry labels; the gradient of the noisy-or tells
each sentence how much of its document's label it has to explain, so the fitted model also
says which sentences offend.

The fit takes a bounded sample (``PER_CLASS`` labelled rows of each class, texts of at most
``MAX_TRAINING_CHARS``); its words and counts fit one process. Scoring covers every row and the
whole text.

Null, empty and wordless texts have no sentence: score 0, no spans. Repeated rows are scored
alike. Without labelled rows of both classes, or words that tell them apart, there is nothing to
go by and every score is 0 (to nine decimals for texts of a million sentences). Labels that
repeat an id count once, as toxic if one of them says so; null labels do not count. Other columns
of the input are ignored.
"""

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import arrow_column, fresh, held_out, training_ids

PER_CLASS = 4_000
MAX_TRAINING_CHARS = 20_000
MAX_WORDS = 50_000
MIN_BAGS = 3
STEM = 4
ASSOCIATION = 5.0
STEPS = 200
RATE = 0.15
DECAY = 1e-5
START_BIAS = -5.0
NO_EVIDENCE = -36.0
THRESHOLD = 0.7
OFFENDING = 0.5

SPAN = "array<struct<start:int,stop:int,score:double>>"
RESULT = f"struct<score:double,spans:{SPAN}>"

_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    """Word weights and the bias of a sentence."""

    weights: dict[str, float]
    bias: float


def features(sentence: str) -> set[str]:
    """Distinct words of a lower-case sentence, and the first letters of the longer ones."""
    words = set(_WORD.findall(sentence))
    return words.union([w[:STEM] + "*" for w in words if len(w) >= STEM])


def bag_words(text: str) -> list[set[str]]:
    """Features of each sentence that has any."""
    return [words for s in _SENTENCE.findall(text.lower()) if (words := features(s))]


class Bags:
    """Texts as bags, cut into sentences anew each time they are gone through: a bag's words take far
    more memory than its text."""

    def __init__(self, texts: list[str]) -> None:
        self._texts = texts

    def __iter__(self) -> Iterator[list[set[str]]]:
        return map(bag_words, self._texts)


def fit_bags(bags: Iterable[list[set[str]]], labels: list[int], steps: int = STEPS) -> ToxicityModel:
    """Word weights by gradient ascent on the noisy-or likelihood of the labels (Adam).

    Only words whose document frequency differs between the classes by ``ASSOCIATION``
    standard deviations get a weight: thousands of chance words would otherwise share the
    blame among them.
    """
    seen: Counter[str] = Counter()
    seen_toxic: Counter[str] = Counter()
    y: list[int] = []
    for bag, label in zip(bags, labels, strict=True):
        if bag:
            words = set().union(*bag)
            seen.update(words)
            if label:
                seen_toxic.update(words)
            y.append(label)
    if len(set(y)) < 2:
        return ToxicityModel({}, NO_EVIDENCE)
    share = sum(y) / len(y)
    apart = {
        w: abs(seen_toxic[w] - n * share) / (n * share * (1 - share) * (1 - n / (len(y) + 1))) ** 0.5
        for w, n in seen.items()
        if n >= MIN_BAGS
    }
    del seen, seen_toxic
    kept = sorted((w for w, z in apart.items() if z >= ASSOCIATION), key=lambda w: (-apart[w], w))[:MAX_WORDS]
    if not kept:
        return ToxicityModel({}, NO_EVIDENCE)
    index = {w: i for i, w in enumerate(kept)}
    flat: list[int] = []
    sentence_of: list[int] = []
    bag_of: list[int] = []
    b = 0
    for bag in bags:
        for words in bag:
            ids = sorted(index[w] for w in words if w in index)
            sentence_of.extend([len(bag_of)] * len(ids))
            flat.extend(ids)
            bag_of.append(b)
        b += bool(bag)
    word, sentence, bag_no = np.array(flat), np.array(sentence_of), np.array(bag_of)
    y = np.array(y, dtype=float)
    n_words, n_sentences = len(kept), len(bag_of)
    weights, bias = np.zeros(n_words), START_BIAS
    first = np.zeros(n_words + 1)
    second = np.zeros(n_words + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(sentence, weights[word], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(bag_no, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        none = np.exp(clean)
        pull = np.where(y > 0, none / np.maximum(1 - none, 1e-6), -1.0)
        slope = p * pull[bag_no]
        grad = np.bincount(word, slope[sentence], minlength=n_words) - DECAY * len(y) * weights
        grad = np.append(grad, slope.sum()) / len(y)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        weights += move[:-1]
        bias += move[-1]
    return ToxicityModel({w: float(x) for w, x in zip(kept, weights, strict=True) if abs(x) > 1e-3}, float(bias))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic) joined to ``documents`` (doc_id, text)."""
    marked = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    sample = training_ids(documents, marked, "toxic", per_class, MAX_TRAINING_CHARS)
    rows = (
        documents.select("doc_id", F.left("text", F.lit(MAX_TRAINING_CHARS)).alias("text"))
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    return fit_bags(Bags([r["text"] for r in rows]), [r["toxic"] for r in rows])


def sentence_scores(text: str, model: ToxicityModel) -> list[tuple[int, int, float]]:
    """Start, stop (code points) and log-odds of each sentence that has a word."""
    get, bias, out = model.weights.get, model.bias, []
    lowered = text.lower()
    if len(lowered) != len(text):  # a few letters grow when lowered; spans must point into the text
        lowered = "".join(c if len(low := c.lower()) != 1 else low for c in text)
    for found in _SENTENCE.finditer(lowered):
        if words := features(found[0]):
            out.append((found.start(), found.end(), bias + sum([get(w, 0.0) for w in words])))
    return out


def toxicity(text: Column, model: ToxicityModel, spark) -> Column:
    """Score of the whole text and the sentences that offend, as one struct column."""
    sent = spark.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def apply(batch: pa.Array) -> pa.Array:
            scores, offsets, starts, stops, odds = [], [0], [], [], []
            for text in batch.to_pylist():
                found = sentence_scores(text, own) if text else []
                z = np.clip(np.array([f[2] for f in found]), -700, 700)
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                for (start, stop, _), p in zip(found, 1 / (1 + np.exp(-z)), strict=True):
                    if p >= OFFENDING:
                        starts.append(start)
                        stops.append(stop)
                        odds.append(float(p))
                offsets.append(len(starts))
            spans = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(odds, pa.float64())],
                ["start", "stop", "score"],
            )
            return pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)],
                ["score", "spans"],
            )

        return apply

    return arrow_column(make, RESULT)(text)


def score_documents(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted (0 or 1), and the offending sentences with their places."""
    spark = documents.sparkSession
    scored = documents.select("doc_id", toxicity(F.col("text"), model, spark).alias("found"))
    return scored.select(
        "doc_id",
        F.col("found.score").alias("score"),
        (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("found.spans").alias("spans"),
    )


def fit_on_folds(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on the labelled rows outside the fold that is held out (crc32 modulo 3 is 1)."""
    return fit(documents, labels.filter(~held_out("doc_id", 3, 1)))


def reject(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    found = fresh(documents, "_toxicity")
    scored = documents.withColumn(found, toxicity(F.col("text"), model, documents.sparkSession))
    return scored.filter(F.col(found)["score"] < THRESHOLD).select(*documents.columns)
