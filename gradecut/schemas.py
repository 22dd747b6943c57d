"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# Raw allocation record: all text. ``n`` is only in older files, ``d`` only in newer ones.
RAW_ALLOCATION = _struct(
    j=_S, c=_S, l=_S, lc=_S, m=_S, sp=_S, lp=_S, lb=_S, nlt=_S, nlo=_S,
    fi=_S, p=_S, f=_S, n=_S, d=_S, um=_S,
)

# A course offer in one year; the mark is in hundredths.
OFFER = _struct(
    year=_I, county=_S, school_code=_S, school_name=_S, spec_id=_S, spec_label=_S,
    profile=_S, track=_S, limba=_S, seats=_I, occupied_seats=_I, last_media_h=_L,
    vocational=_B,
)

# The same offer inside a nested published document, mark as a decimal.
NESTED_ROW = _struct(
    year=_I, county=_S, school_code=_S, school_name=_S, spec_id=_S, spec_label=_S,
    profile=_S, track=_S, limba=_S, seats=_I, occupied_seats=_I,
    last_media=T.DecimalType(4, 2), vocational=_B,
)
NESTED_DATASET = _struct(
    schema_version=_I, year=_I, county=_S, part=_I, generated_at=_S, provenance=_S,
    sources=T.ArrayType(_S), rows=T.ArrayType(NESTED_ROW),
)

INDEX_ENTRY = _struct(year=_I, county=_S, path=_S, row_count=_L, provenance=_S)

# Names of the published JSON that differ from the ones used here.
CONTRACT_NAMES = {
    "schema_version": "schemaVersion",
    "generated_at": "generatedAt",
    "school_code": "schoolCode",
    "school_name": "schoolName",
    "spec_id": "specId",
    "spec_label": "specLabel",
    "track": "filiera",
    "occupied_seats": "occupiedSeats",
    "last_media": "lastMedia",
}


def _contract(own: T.StructType, **kinds: T.DataType) -> T.StructType:
    """A schema under the contract's names; ``kinds`` gives the types that differ there."""
    return T.StructType(
        [T.StructField(CONTRACT_NAMES.get(f.name, f.name), kinds.get(f.name, f.dataType)) for f in own if f.name != "part"]
    )


# Marks are doubles in JSON; a decimal would round a faulty one into a good one.
CONTRACT_ROW = _contract(NESTED_ROW, last_media=T.DoubleType())
CONTRACT_DATASET = _contract(NESTED_DATASET, rows=T.ArrayType(CONTRACT_ROW))
SAVED_COURSES = T.ArrayType(_struct(snapshots=T.ArrayType(CONTRACT_DATASET)))

EXAM_SAMPLE = _struct(
    nota_finala_romana=T.DecimalType(4, 2),
    nota_finala_limba_materna=T.DecimalType(4, 2),
    nota_finala_matematica=T.DecimalType(4, 2),
    media=T.DecimalType(4, 2),
)
EXAM_BACKTEST = _struct(
    media_v_viii=T.DecimalType(4, 2),
    nota_finala_romana=T.DecimalType(4, 2),
    nota_finala_matematica=T.DecimalType(4, 2),
    media=T.DecimalType(4, 2),
)
SCHOOL_SAMPLE = _struct(
    school_code=_S,
    school_media=T.DecimalType(4, 2),
    romana=T.DecimalType(4, 2),
    matematica=T.DecimalType(4, 2),
    media=T.DecimalType(4, 2),
)

PAGE = _struct(url=_S, html=_S)
MANIFEST = _struct(url=_S, file=_S, fetched_at=_S, status=_I, bytes=_L)
