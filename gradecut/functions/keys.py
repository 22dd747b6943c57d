"""Keys, lookups and small predicates on offers and years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradecut.functions.text import compose_nfc
from gradecut.params import COUNTY_BY_PREFIX, COUNTY_NAMES, EPOCH_YEAR

IDENTITY_COLS = ("school_code", "spec_label", "profile", "track", "limba")


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(text) for pair in table.items() for text in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def county_of_school(code: Column) -> Column:
    """County of a school code by its first two digits; null for an unknown prefix."""
    return _lookup(COUNTY_BY_PREFIX, F.substring(F.trim(code), 1, 2))


def county_name(code: Column) -> Column:
    return F.coalesce(_lookup(COUNTY_NAMES, code), code)


def course_label(label: Column, bilingual: Column, dual: Column) -> Column:
    """Displayed course label with its bilingual and dual marks."""
    return F.concat(
        label,
        F.when(bilingual != "-", F.concat(F.lit(" (bilingv: "), bilingual, F.lit(")"))).otherwise(""),
        F.when(dual, " (dual)").otherwise(""),
    )


def spec_key(school_code: Column, spec_id: Column) -> Column:
    return F.concat_ws("/", school_code, spec_id)


def course_id(county: Column, year: Column, school_code: Column, spec_id: Column) -> Column:
    return F.concat_ws("/", county, year.cast("string"), school_code, spec_id)


def identity_part(part: Column, compose: bool = False) -> Column:
    """One part of the cross-year course identity: lower case, cedillas turned to commas.

    Rows that came through ``sources.archive`` are composed already; pass ``compose=True``
    for text of unknown origin.
    """
    text = compose_nfc(part) if compose else part
    return F.translate(F.lower(text), "şţ", "șț")


def has_vacancies(occupied: Column, seats: Column) -> Column:
    """Unknown occupancy is not a vacancy."""
    return F.coalesce(occupied < seats, F.lit(False))


def usable_mark(mark: Column, occupied: Column, seats: Column, vocational: Column) -> Column:
    """The mark where it bound admission: filled and not decided by an aptitude test."""
    return F.when(~has_vacancies(occupied, seats) & ~vocational, mark)


def comparable_years(a: Column, b: Column, epoch_year: int = EPOCH_YEAR) -> Column:
    return (a >= epoch_year) == (b >= epoch_year)


def target_year(today: Column, grade: Column, latest_year: Column, exam_grade: int = 8) -> Column:
    """Admission year of a pupil: the next exam from today on, pushed out by the grades left."""
    next_exam = F.year(today) + F.when(F.month(today) >= 9, 1).otherwise(0)
    return F.greatest(latest_year + 1, next_exam) + exam_grade - grade
