"""Quality rules: a table of thresholds compiled into one projection of native expressions.

Every text gets counts of its words, symbols and lines; ``RULES`` names ratios of these counts with
the range a good text keeps them in, and ``verdict`` turns the whole table into one boolean
expression. Another table of rules over the same counts needs no new code.

A word is a run of characters that are no ASCII white space. A window is three words in a row; a
word is repeated if a window it stands in occurs twice or more in its text. Windows are compared by
hash first, since most texts repeat none; only where two hashes are equal are the windows
themselves sorted, so the count is exact and costs n log n for a text of any length.

Null and empty texts have no word: every count is 0, the base rules fail and the text is not kept.
Every row gets one row, repeated ids and null ids too; an empty table gives an empty result. Other
columns are ignored, whatever they are called.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WINDOW = 3

_SPACE = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"

# fixed values: the most frequent function words of the four languages
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as be by this are at from",
    "de": "der die und in den von zu das mit sich des auf für im ist nicht dem ein eine als",
    "fr": "de la le et les des en un du que une pour est qui dans par sur pas au avec",
    "es": "de la que el en y los las se del un por con no su una para es al lo",
}


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * part / whole <= high``, all counts being columns of ``measures``.

    A rule holds where ``whole`` is 0. Bounds are whole percents (or hundredths of a mean), so the
    comparison is exact in 64-bit integers.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole)
        checks = [F.lit(True)]
        if self.low is not None:
            checks.append(part >= whole * self.low)
        if self.high is not None:
            checks.append(part <= whole * self.high)
        found = checks[0]
        for check in checks[1:]:
            found = found & check
        return (whole == 0) | found


RULES = (
    Rule("mean word length", "word_chars", "n_words", low=250, high=1200),
    Rule("symbols to words", "n_symbols", "n_words", high=20),
    Rule("stop words to words", "n_stop_words", "n_words", low=6),
    Rule("repeated lines to lines", "n_dup_lines", "n_lines", high=50),
)


def stop_pattern(stop_words: dict[str, str] = STOP_WORDS) -> str:
    """A pattern for a stop word that stands between characters that are no letters, in any case."""
    each = sorted({w for words in stop_words.values() for w in words.split()})
    return f"(?iu)(?<!\\p{{L}})(?:{'|'.join(each)})(?!\\p{{L}})"


def measures(documents: DataFrame, text: str = "text", stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """doc_id and the counts that rules may use, all bigint.

    n_words, word_chars (code points in words), n_symbols, n_stop_words, n_lines (lines with a
    word), n_dup_lines (those equal to an earlier one), n_repeat_words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, _SPACE, -1), "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(_WORD))
    cut = documents.select("doc_id", body.alias("body"), words.alias("words"), lines.alias("lines"))

    word = lambda i: F.get("words", i)
    last = F.size("words") - WINDOW
    none = F.array().cast("array<bigint>")
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(word(i + k) for k in range(WINDOW))))
    cut = cut.withColumn("hashes", F.when(last >= 0, hashed).otherwise(none))

    # only where hashes meet: the windows in order, each with its place
    parts = [f"w{k}" for k in range(WINDOW)]
    window = lambda i: F.struct(*(word(i + k).alias(p) for k, p in enumerate(parts)), i.alias("at"))
    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), last), window))
    meets = F.size(F.array_distinct("hashes")) < F.size("hashes")
    cut = cut.withColumn("ordered", F.when(meets, ordered))

    def same(x: Column, i: Column) -> Column:
        other = F.get("ordered", i)
        equal = F.lit(True)
        for p in parts:
            equal = equal & (x[p] == other[p])
        return F.coalesce(equal, F.lit(False))

    twice = F.filter("ordered", lambda x, i: same(x, i - 1) | same(x, i + 1))
    cut = cut.withColumn("at", F.transform(twice, lambda x: x["at"]))
    held = F.transform("at", lambda p: F.array(*(p + k for k in range(WINDOW))))
    covered = F.array_distinct(F.flatten(held))

    whole = F.array_join("words", "")
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(whole),
        "n_symbols": F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")),
        "n_stop_words": F.regexp_count("body", F.lit(stop_pattern(stop_words))),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.col("at").isNull(), 0).otherwise(F.size(covered)),
    }
    # generated columns, as a filter on plain ones would be pushed down and count anew for every word
    return cut.select("doc_id", F.inline(F.array(F.struct(*(c.cast("bigint").alias(n) for n, c in counts.items())))))


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Whether the base rules fail, and whether the row is kept by these and all of ``rules``."""
    few = F.col("n_words") < LEAST_WORDS
    failed = few | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    kept = ~failed
    for rule in rules:
        kept = kept & rule.holds()
    return failed, kept


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the names of the rules that a row breaks."""
    failed, kept = verdict(rules)
    broken = F.array_compact(F.array(*(F.when(~r.holds(), F.lit(r.name)) for r in rules)))
    return measures(documents).select("*", failed.alias("base_failed"), kept.alias("kept"), broken.alias("broken"))


def keep(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id of the rows that are kept."""
    return judge(documents, rules).filter("kept").select("doc_id")
