r"""Chat formatting by prefix-target expansion, in native expressions.

Every assistant turn becomes an example of its own: all turns before it are the context, its
text alone is trainable. A conversation that does not end with an assistant turn also gives one
example without a target, so that no turn is lost. Each example is one string; ``loss_start``
and ``loss_stop`` (code points, from 0) mark its trainable part, which is empty in the example
without a target.

A turn is written as ``### role </role>``, a new line, the text, `` </turn>`` and a new line.
Inside roles and texts ``\``, ``#`` and ``<`` get a ``\`` before them, so ``###`` and `` <``
occur in the template alone and reading back is exact for any text, whatever control strings it
holds.

Rows are ordered by turn, then role, then text, nulls first; repeated rows are turns of their
own. Null roles and texts are empty strings, rows with a null ``conv_id`` form one conversation.
Other columns of the input are ignored; an empty table gives no examples. A conversation is one
row by its nature (its prefixes are strings), so its length is bounded by what a row can hold.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
HEAD = "### "
ROLE_END = " </role>\n"
TURN_END = " </turn>\n"


def escape(text: Column) -> Column:
    """Control characters with a backslash before them."""
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    """Inverse of ``escape``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 1), formatted, loss_start and loss_stop of ``conversations`` (conv_id, turn, role, text)."""
    turns = (
        conversations.select(
            "conv_id",
            F.struct(
                "turn",
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
            ).alias("row"),
        )
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
    )
    written = turns.select(
        "conv_id",
        F.transform(
            "rows",
            lambda r: F.struct(
                (r["role"] == ASSISTANT).alias("target"),
                F.concat(F.lit(HEAD), escape(r["role"]), F.lit(ROLE_END)).alias("head"),
                escape(r["text"]).alias("text"),
            ),
        ).alias("turns"),
    )
    last = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: F.element_at("turns", i)["target"] | (i == last))
    cut = written.select("conv_id", "turns", F.posexplode(ends).alias("nth", "stop"))
    before = F.array_join(
        F.transform(
            F.slice("turns", F.lit(1), F.col("stop") - 1), lambda t: F.concat(t["head"], t["text"], F.lit(TURN_END))
        ),
        "",
    )
    own = F.element_at("turns", F.col("stop"))
    parts = cut.select("conv_id", (F.col("nth") + 1).alias("example"), before.alias("context"), own.alias("own"))
    start = F.char_length("context") + F.char_length("own.head")
    return parts.select(
        "conv_id",
        "example",
        F.concat("context", "own.head", "own.text", F.lit(TURN_END)).alias("formatted"),
        F.when(F.col("own.target"), start).otherwise(0).alias("loss_start"),
        F.when(F.col("own.target"), start + F.char_length("own.text")).otherwise(0).alias("loss_stop"),
    )


def parse(formatted: Column) -> Column:
    """Turns (role, text) of an example, read back from its string."""
    pieces = F.split(formatted, TURN_END, -1)
    body = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, ROLE_END, 1)
        text = F.substr(piece, F.char_length(head) + F.lit(len(ROLE_END) + 1))
        return F.struct(
            unescape(F.substr(head, F.lit(len(HEAD) + 1))).alias("role"),
            unescape(text).alias("text"),
        )

    return F.transform(body, turn)


def trained_text(formatted: Column, start: Column, stop: Column) -> Column:
    """The trainable part of an example, unescaped."""
    return unescape(F.substr(formatted, start + 1, stop - start))


def digest(made: DataFrame) -> DataFrame:
    """What the examples of each conversation say, read back from them.

    conv_id, n_turns and turns_sha256 from the longest example; loss_chars and loss_sha256 from
    the trainable parts in order; formatted_chars, the length of all examples together.
    """
    read = made.select(
        "conv_id",
        "example",
        "formatted",
        trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_stop")).alias("trained"),
    )
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("example", "trained"))), lambda x: x["trained"]), ""
        ).alias("trained"),
        F.sum(F.char_length("formatted").cast("long")).alias("formatted_chars"),
    )
    turns = whole.select("*", parse(F.col("longest")).alias("turns"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
