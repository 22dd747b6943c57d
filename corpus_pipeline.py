"""Corpus preparation: toxicity, language, near duplicates, benchmark overlaps, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; ``run``
writes every stage's result to the shared folder as Parquet and reads it back as the next one's
input. All stages but the last return the columns of documents. Models are fitted on the given
tables' labelled folds, never on what a stage has to judge alone.

An empty table passes through every stage empty. Null texts are dropped by the language stage
(they have no letter). Rows that are equal in id and text are judged alike and one of them stays; a null id
is an id like any other, after all others. Texts are taken whole, however long. Further columns stay, whatever they are called.
What a stage writes on its way is removed when its result is written.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradecut.llm import decontaminate, language, pieces, similar, toxicity
from gradecut.llm.common import read_table
from gradecut.session import scratch

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    model = toxicity.fit_on_folds(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach."""
    return language.reject(docs, language.fit_on_folds(read_table(spark, sf_dir, "documents")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more over five words in a row.

    Pairs come from the fingerprints' trie join of operator 4 and, as its budget misses many at 0.8, from MinHash bands.
    """
    return similar.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def into_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the ids of the best segmentation, the n best scores and the edits for the others."""
    return pieces.tokenize(docs, pieces.load_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("simhash", one_of_each),
    ("decontamination", without_benchmark),
    ("pieces", into_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir))
    return docs
