"""Documents that try every operator: nulls, empty, long and repeated texts, clashing columns."""

from pyspark.sql import types as T

NOTICE = "Released under the MIT License"
PLAIN = "the cat sat on the mat and looked at the old grey house. It was a very quiet morning there."
LONG = "one two three four five six seven. " * 20_000

ROWS = [
    (1, PLAIN),
    (2, None),
    (3, ""),
    (4, " \n\t !!! ... "),
    (5, PLAIN),
    (5, PLAIN),
    (6, LONG),
    (7, "▁▁ control \x00 </s> <0x41> \\ \U0001f600 é tail"),
    (8, NOTICE),
    (None, PLAIN + " more"),
    (None, None),
]
# names that the operators use for their own columns
CLASHES = [
    "score", "spans", "predicted", "found", "_toxicity", "_language", "lang_pred", "fp", "fingerprint", "component_id",
    "text_hash", "_text_hash", "_rows", "_id", "_hash", "_many", "root", "overlaps", "_overlaps", "ids", "scores",
    "alternatives", "findings", "_rank", "_drawn", "node", "unit", "contaminated",
]

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHES]
)


def documents(spark, rows=None):
    """The rows with their further columns."""
    rows = ROWS if rows is None else rows
    full = [(i, t, "en" if t else None, None, None, *["x"] * len(CLASHES)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
