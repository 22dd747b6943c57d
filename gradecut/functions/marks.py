"""Mark arithmetic in integer hundredths, and the text forms marks arrive in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradecut.params import MARK_MAX, MARK_MAX_H, MARK_MIN, MARK_MIN_H

# Cell contents that mean "no mark published".
EMPTY_CELLS = ("", "-", "--", "—", "–", "n/a", "N/A", ".", "*")
# Everything the source language calls white space.
ANY_SPACE = r"[\s\x0B\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def int_div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def in_scale_h(mark_h: Column) -> Column:
    return mark_h.between(MARK_MIN_H, MARK_MAX_H)


def exam_average_h(romana_h: Column, matematica_h: Column, third_h: Column | None = None) -> Column:
    """Average of two papers, or of three when the third was sat; truncated, never rounded."""
    two = int_div(romana_h + matematica_h, 2)
    if third_h is None:
        return two
    return F.when(third_h.isNull(), two).otherwise(int_div(romana_h + third_h + matematica_h, 3))


def grade_error(mark: Column) -> Column:
    """Why ``mark`` (double) is not a grade of at most two decimals, or null when it is one."""
    scaled = mark * 100
    return (
        F.when(mark.isNull() | F.isnan(mark) | (F.abs(mark) == float("inf")), "not finite")
        .when((mark < MARK_MIN) | (mark > MARK_MAX), "outside 1..10")
        .when(F.abs(scaled - F.round(scaled)) > 1e-6, "more than two decimals")
    )


def to_hundredths(mark: Column, on_error: str = "null") -> Column:
    """Exact hundredths of a double grade; invalid grades give null, or fail the job."""
    error = grade_error(mark)
    bad = F.raise_error(F.concat(F.lit("grade "), error)).cast("bigint") if on_error == "raise" else None
    return F.when(error.isNull(), F.round(mark * 100).cast("bigint")).otherwise(bad)


def truncate_two_decimals(value: Column) -> Column:
    """Cut the decimal expansion after two digits, toward zero on both sides of it."""
    # Ten decimals shed the binary noise, the cast to bigint drops the rest of the digits.
    cents = (value.cast("decimal(28,10)") * F.lit(100).cast("decimal(3,0)")).cast("bigint")
    return cents / F.lit(100.0)


def _cell_text(raw: Column) -> Column:
    return F.regexp_replace(raw, ANY_SPACE + "+", "")


def _cell_value(text: Column) -> Column:
    whole = F.regexp_extract(text, r"^(\d{1,2})(?:[.,]\d+)?$", 1)
    fraction = F.regexp_extract(text, r"^\d{1,2}[.,](\d+)$", 1)
    digits = F.rpad(F.substring(fraction, 1, 2), 2, "0")
    return F.when(whole != "", whole.cast("bigint") * 100 + digits.cast("bigint"))


def media_cell_error(raw: Column) -> Column:
    """Why a published cutoff cell cannot be read; null for a mark or an empty marker."""
    text = _cell_text(raw)
    value = _cell_value(text)
    return (
        F.when(raw.isNull(), "missing cell")
        .when(text.isin(*EMPTY_CELLS), F.lit(None).cast("string"))
        .when(value.isNull(), F.concat(F.lit("cell holds no mark "), raw))
        .when(~in_scale_h(value), F.concat(F.lit("media outside 1..10: "), raw))
    )


def parse_media_cell(raw: Column, on_error: str = "raise") -> Column:
    """Published cutoff cell to hundredths; blanks and dashes give null, unknown text fails.

    Surplus decimals are cut as text. With ``on_error='null'`` pair this with
    ``media_cell_error`` so that unreadable cells are reported rather than lost.
    """
    text = _cell_text(raw)
    error = media_cell_error(raw)
    bad = F.raise_error(error).cast("bigint") if on_error == "raise" else F.lit(None).cast("bigint")
    return (
        F.when(error.isNotNull(), bad)
        .when(text.isin(*EMPTY_CELLS), F.lit(None).cast("bigint"))
        .otherwise(_cell_value(text))
    )


def parse_media_input(raw: Column) -> Column:
    """A typed mark to hundredths; anything else is null, never an error."""
    text = F.regexp_replace(raw, f"^{ANY_SPACE}+|{ANY_SPACE}+$", "")
    pattern = r"^(\d+)(?:[.,](\d*))?$"
    whole = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    fraction = F.regexp_extract(text, pattern, 2)
    value = whole * 100 + F.rpad(F.substring(fraction, 1, 2), 2, "0").cast("bigint")
    above = (whole == 10) & fraction.rlike("[1-9]")
    return F.when(text.rlike(pattern) & whole.between(1, 10) & ~above, value)


def format_media_h(mark_h: Column) -> Column:
    """Two-decimal text; null becomes the empty string."""
    text = F.format_string("%d.%02d", int_div(mark_h, 100), mark_h % 100)
    return F.when(mark_h.isNull(), "").otherwise(text)


# What a sheet writes for a number: digits, a fraction, an exponent; no type suffix, no hexadecimal.
_SHEET_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"


# The characters of ANY_SPACE one by one.
_SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def _sheet_text(raw: Column) -> Column:
    return F.btrim(raw, F.lit(_SPACES))


def _sheet_hundredths(text: Column) -> Column:
    """The number that a trimmed cell writes, in hundredths on the scale or off it; null for no number."""
    value = F.when(text.rlike(_SHEET_NUMBER), text.try_cast("double"))
    return F.floor(value * 100 + 0.5)


def _sheet_error(raw: Column, text: Column, hundredths: Column) -> Column:
    return (
        F.when(raw.isNull() | text.isin("", "-"), F.lit(None).cast("string"))
        .when(hundredths.isNull(), F.concat(F.lit("not a number: "), raw))
        .when(~in_scale_h(hundredths), F.concat(F.lit("outside 1..10: "), raw))
    )


def sheet_cells(*raw: str) -> Column:
    """``sheet_grade_error`` and ``parse_sheet_grade`` of several cells, each read once: an array of (error, mark_h)."""
    cells = F.transform(F.array(*raw), lambda c: F.struct(c.alias("raw"), _sheet_text(c).alias("text")))
    cells = F.transform(cells, lambda c: F.struct(c["raw"], c["text"], _sheet_hundredths(c["text"]).alias("h")))
    mark = lambda c: F.when(in_scale_h(c["h"]), c["h"])
    return F.transform(
        cells, lambda c: F.struct(_sheet_error(c["raw"], c["text"], c["h"]).alias("error"), mark(c).alias("mark_h"))
    )


def sheet_grade_error(raw: Column) -> Column:
    text = _sheet_text(raw)
    return _sheet_error(raw, text, _sheet_hundredths(text))


def parse_sheet_grade(raw: Column, on_error: str = "raise") -> Column:
    """A grade cell of a double-typed sheet, to hundredths, shedding the binary noise.

    For several cells a row take ``sheet_cells``.
    """
    hundredths = _sheet_hundredths(_sheet_text(raw))
    error = sheet_grade_error(raw)
    bad = F.raise_error(error).cast("bigint") if on_error == "raise" else F.lit(None).cast("bigint")
    return F.when(error.isNotNull(), bad).otherwise(hundredths)


def media_status(romana_h: Column, matematica_h: Column, third_h: Column, media_h: Column) -> Column:
    """'incomplete', 'ok' or 'mismatch' of a published average against the recomputed one."""
    missing = romana_h.isNull() | matematica_h.isNull() | media_h.isNull()
    matches = exam_average_h(romana_h, matematica_h, third_h) == media_h
    return F.when(missing, "incomplete").when(matches, "ok").otherwise("mismatch")


def is_complete(romana: Column, matematica: Column, media: Column, school_media: Column) -> Column:
    return romana.isNotNull() & matematica.isNotNull() & media.isNotNull() & school_media.isNotNull()


def is_eligible(
    romana: Column, matematica: Column, media: Column, school_media: Column, third: Column
) -> Column:
    """Counts toward the calibration: complete, and no third paper."""
    return is_complete(romana, matematica, media, school_media) & third.isNull()


def snap_to_grid_h(mark_h: Column, step_h: int) -> Column:
    """Nearest grid point, halves upward."""
    return int_div(mark_h * 2 + step_h, 2 * step_h) * step_h


def clamp(mark: Column) -> Column:
    return F.least(F.lit(MARK_MAX), F.greatest(F.lit(MARK_MIN), mark))


def scale_position(mark: Column, low: Column | float = MARK_MIN, high: Column | float = MARK_MAX) -> Column:
    """Where a mark sits between two ends, in percent; a null mark fills nothing."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    share = (mark - low) / (high - low) * 100
    return F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), share)), F.lit(0.0))
