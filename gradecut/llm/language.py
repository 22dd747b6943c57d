"""Language of a text by a string kernel: blended spectrum, Nystroem landmarks, ridge regression.

The kernel of two texts is the cosine of their sets of letter n-grams, all n from 1 to
``MAX_N`` together (the blended-spectrum presence kernel). ``LANDMARKS`` training texts span a
Nystroem approximation of it; in that space one kernel ridge regression per language is solved
against the others. A batch of texts is scored by two matrix products: presence rows times the
landmarks' presence columns give the kernel rows, which the solved coefficients turn into one
score for each language.

Texts are lower-cased; everything but letters becomes one separator. The most frequent letters of
the training texts have symbols of their own, all others share ``OTHERS`` symbols by their code, so that scripts
of thousands of letters are still told apart by which symbols follow each other. Presence is
taken over the whole text. The norm of a text counts all its distinct n-grams, those outside
the landmarks included, so kernel values are exact.

The fit takes a bounded sample: ``PER_LANGUAGE`` rows of each language, texts of at most
``MAX_TRAINING_CHARS`` before longer ones, of which it takes so many characters. Null texts and texts without a letter are ``und`` with score 0, as is
every text when nothing was labelled. With one labelled language every text with letters gets
it. Repeated rows are judged alike; ties go to the language that sorts first. Other columns of
the input are ignored.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradecut.llm.common import arrow_column, fresh, held_out, training_ids

MAX_N = 3
ALPHABET = 128
OTHERS = 32
LANDMARKS = 192
PER_LANGUAGE = 400
MAX_TRAINING_CHARS = 20_000
RIDGE = 1e-2
UNKNOWN = "und"
LEAST_SCORE = 0.25
BATCH = 64

RESULT = "struct<lang:string,score:double>"


@dataclass(frozen=True)
class LanguageModel:
    """Landmark n-grams and ridge coefficients.

    ``columns[n - 1][code]`` is the matrix column of an n-gram or -1, ``landmarks`` has a
    column for each landmark and ``coefficients`` one for each language.
    """

    letters: str
    languages: list[str]
    columns: list[np.ndarray]
    landmarks: np.ndarray
    norms: np.ndarray
    coefficients: np.ndarray


def _shared(codes: np.ndarray) -> np.ndarray:
    """Symbols of letters that have none of their own."""
    return 1 + ((codes.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(16)) % np.uint64(OTHERS)).astype(np.int32)


def letter_table(letters: str) -> np.ndarray:
    """Symbol of every code point of the basic plane: 0 separator, then ``OTHERS`` shared ones, then the letters."""
    codes = np.arange(0x10000)
    table = np.where([chr(c).isalpha() for c in codes], _shared(codes), 0).astype(np.int32)
    for i, c in enumerate(letters):
        table[ord(c)] = 1 + OTHERS + i
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text with runs of separators as one, framed by separators."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found = np.where(codes < 0x10000, table[np.minimum(codes, 0xFFFF)], _shared(codes))
    framed = np.concatenate(([0], found, [0]))
    return framed[np.concatenate(([True], (framed[1:] != 0) | (framed[:-1] != 0)))]


def gram_codes(found: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams of each length."""
    out, code = [found], found
    for n in range(2, MAX_N + 1):
        code = code[: max(len(found) - n + 1, 0)] * ALPHABET + found[n - 1 :]
        out.append(code)
    return out


class Presence:
    """Distinct n-gram codes of one text after another, through reused bitmaps."""

    def __init__(self) -> None:
        self._marks = [np.zeros(ALPHABET**n, bool) for n in range(1, MAX_N + 1)]

    def distinct(self, found: np.ndarray) -> list[np.ndarray]:
        out = []
        for mark, codes in zip(self._marks, gram_codes(found), strict=True):
            mark[codes] = True
            if 50 * len(codes) < len(mark):
                codes = codes[np.argsort(codes, kind="stable")]
                out.append(codes[np.concatenate(([True], codes[1:] != codes[:-1]))] if len(codes) else codes)
            else:
                out.append(np.flatnonzero(mark))
            mark[codes] = False
        return out


def kernel_rows(texts: list[str], model: LanguageModel, table: np.ndarray, presence: Presence) -> np.ndarray:
    """Kernel of each text with every landmark."""
    rows = np.zeros((len(texts), len(model.landmarks)), np.float32)
    norms = np.ones(len(texts))
    for i, text in enumerate(texts):
        grams = presence.distinct(symbols(text, table))
        for columns, codes in zip(model.columns, grams, strict=True):
            hit = columns[codes]
            rows[i, hit[hit >= 0]] = 1
        norms[i] = max(sum(map(len, grams)), 1) ** 0.5
    return (rows @ model.landmarks) / (norms[:, None] * model.norms[None, :])


def fit_texts(texts: list[str], languages: list[str]) -> LanguageModel | None:
    """Solve the ridge regressions; landmarks are drawn from each language in turn."""
    pairs = [(t, lang) for t, lang in zip(texts, languages, strict=True) if any(c.isalpha() for c in t)]
    if not pairs:
        return None
    names = sorted({lang for _, lang in pairs})
    counts = Counter()
    for text, _ in pairs:
        counts.update(text.lower())
    letters = sorted((c for c in counts if c.isalpha() and ord(c) < 0x10000), key=lambda c: (-counts[c], c))
    letters = "".join(letters[: ALPHABET - 1 - OTHERS])
    table, presence = letter_table(letters), Presence()
    by_name = [[t for t, lang in pairs if lang == name] for name in names]
    turns = [t for turn in range(max(map(len, by_name))) for group in by_name for t in group[turn : turn + 1]]
    chosen = list(dict.fromkeys(turns))[:LANDMARKS]
    grams = [presence.distinct(symbols(t, table)) for t in chosen]
    columns, width = [], 0
    for n in range(MAX_N):
        used = np.unique(np.concatenate([g[n] for g in grams]))
        column = np.full(ALPHABET ** (n + 1), -1, np.int32)
        column[used] = np.arange(width, width + len(used))
        columns.append(column)
        width += len(used)
    landmarks = np.zeros((width, len(chosen)), np.float32)
    for j, found in enumerate(grams):
        for column, codes in zip(columns, found, strict=True):
            landmarks[column[codes], j] = 1
    norms = np.sqrt(np.maximum(landmarks.sum(axis=0), 1)).astype(float)
    bare = LanguageModel(letters, names, columns, landmarks, norms, np.zeros((len(chosen), len(names))))
    rows = np.concatenate(
        [kernel_rows([t for t, _ in pairs[i : i + BATCH]], bare, table, presence) for i in range(0, len(pairs), BATCH)]
    )
    among = (landmarks.T @ landmarks) / (norms[:, None] * norms[None, :])
    values, vectors = np.linalg.eigh(among.astype(float))
    sound = values > 1e-6 * values[-1]
    whiten = vectors[:, sound] / np.sqrt(values[sound])
    mapped = np.hstack([rows @ whiten, np.ones((len(rows), 1))])
    goals = np.array([[1.0 if lang == name else 0.0 for name in names] for _, lang in pairs])
    weight = np.array([1 / sum(lang == other for _, other in pairs) for lang in names])
    each = goals @ weight  # every language counts alike
    gram = (mapped * each[:, None]).T @ mapped
    solved = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), (mapped * each[:, None]).T @ goals)
    coefficients = np.vstack([whiten @ solved[:-1], solved[-1:]])
    return LanguageModel(letters, names, columns, landmarks, norms, coefficients)


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Fit on a bounded sample of the rows of ``documents`` (doc_id, text, lang) that have both."""
    known = documents.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).distinct()
    sample = training_ids(documents, known, "lang", per_language, MAX_TRAINING_CHARS)
    rows = (
        documents.select("doc_id", "lang", F.left("text", F.lit(MAX_TRAINING_CHARS)).alias("text"))
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(sample), ["doc_id", "lang"])
        .groupBy("doc_id", "lang")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    return fit_texts([r["text"] for r in rows], [r["lang"] for r in rows])


def language(text: Column, model: LanguageModel | None, spark) -> Column:
    """Predicted language and its score as one struct column."""
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if model is None:
        return unknown
    sent = spark.sparkContext.broadcast(model)

    def make():
        own = sent.value
        table, presence = letter_table(own.letters), Presence()

        def apply(batch: pa.Array) -> pa.Array:
            texts, names, scores = batch.to_pylist(), [], []
            for start in range(0, len(texts), BATCH):
                part = [t or "" for t in texts[start : start + BATCH]]
                kernel = kernel_rows(part, own, table, presence)
                found = kernel @ own.coefficients[:-1] + own.coefficients[-1]
                best = found.argmax(axis=1)
                lettered = [any(c.isalpha() for c in t) for t in part]
                names += [own.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                top = np.clip(found[np.arange(len(part)), best], 0, 1)
                scores += [float(s) if ok else 0.0 for s, ok in zip(top, lettered, strict=True)]
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

        return apply

    return arrow_column(make, RESULT)(text)


def predict(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    found = documents.select("doc_id", language(F.col("text"), model, documents.sparkSession).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def fit_on_folds(documents: DataFrame) -> LanguageModel | None:
    """Fit on the rows outside the fold that is held out (crc32 modulo 5 is 0)."""
    return fit(documents.filter(~held_out("doc_id", 5, 0)))


def reject(documents: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The documents in a language that was learned, with their own columns.

    Rejected are texts without letters and texts whose best score stays under ``LEAST_SCORE``:
    they resemble none of the languages.
    """
    found = fresh(documents, "_language")
    judged = documents.withColumn(found, language(F.col("text"), model, documents.sparkSession))
    keep = (F.col(found)["lang"] != UNKNOWN) & (F.col(found)["score"] >= LEAST_SCORE)
    return judged.filter(keep).select(*documents.columns)
