"""Faults inside saved shortlists: every fault of every document, by its path.

``pages.read_shortlist`` stops at the first document that breaks the contract. Here documents are
parsed as VARIANT, which takes any JSON, and its parts are judged by typed paths, so that one bad
field costs neither the other documents nor the other faults of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradecut.params import MAX_SAVED
from gradecut.schemas import CONTRACT_DATASET, CONTRACT_ROW
from gradecut.session import cut_lineage

_OPTIONAL = ("occupiedSeats", "lastMedia")
_KINDS = {
    T.StringType: ("expected text", lambda kind: kind == "STRING"),
    T.IntegerType: ("expected a whole number", lambda kind: kind == "BIGINT"),
    T.BooleanType: ("expected true or false", lambda kind: kind == "BOOLEAN"),
    T.ArrayType: ("expected an array", lambda kind: kind.startswith("ARRAY")),
    T.DoubleType: ("expected a number", lambda kind: kind.rlike("^(BIGINT|DECIMAL|DOUBLE)")),
}


def _part(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _items(value: Column, path: str = "$") -> Column:
    """An array's elements; none where it is no array."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _fault(when: Column, path: Column, message: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(path.alias("path"), F.lit(message).alias("message")))


def _field_faults(value: Column, fields: T.StructType, path: Column) -> list[Column]:
    """Fields that are absent, null or of another kind."""
    found = []
    for field in fields:
        kind = F.schema_of_variant(_part(value, field.name))
        place = F.concat(path, F.lit(f".{field.name}"))
        absent = kind.isNull() | (kind == "VOID")
        if field.name not in _OPTIONAL:
            found.append(_fault(absent, place, "missing"))
        message, fits = _KINDS[type(field.dataType)]
        found.append(_fault(~absent & ~fits(kind), place, message))
    return found


def _listed(df: DataFrame, keep: list[str], faults: list[Column]) -> DataFrame:
    each = df.select(*keep, F.explode(F.array_compact(F.array(*faults))).alias("_f"))
    return each.select(*keep, "_f.path", "_f.message")


def shortlist_faults(raw: DataFrame, owner: str, column: str = "raw", max_saved: int = MAX_SAVED) -> DataFrame:
    """owner, path and message of every fault; one document (or null for nothing saved) for each owner."""
    keep = [owner]
    docs = raw.filter(F.col(column).isNotNull()).select(*keep, F.try_parse_json(column).alias("_v"))
    kind = F.schema_of_variant("_v")
    size = F.size(_items(F.col("_v")))
    top = _listed(
        docs,
        keep,
        [
            _fault(F.col("_v").isNull(), F.lit("$"), "not JSON"),
            _fault(~kind.startswith("ARRAY"), F.lit("$"), "expected an array"),
            _fault(size > max_saved, F.lit("$"), f"more than {max_saved} saved courses"),
        ],
    )
    at = lambda name, n: F.concat(F.lit(f"{name}["), F.col(n).cast("string"), F.lit("]"))
    courses = docs.select(*keep, F.posexplode(_items(F.col("_v"))).alias("_n", "_course"))
    courses = courses.withColumn("_at", at("$", "_n"))
    snapshots = T.StructType([T.StructField("snapshots", T.ArrayType(T.StringType()))])
    in_courses = _listed(courses, keep, _field_faults(F.col("_course"), snapshots, F.col("_at")))
    shots = courses.select(*keep, "_at", F.posexplode(_items(F.col("_course"), "$.snapshots")).alias("_s", "_shot"))
    shots = shots.withColumn("_at", F.concat("_at", at(".snapshots", "_s")))
    in_shots = _listed(shots, keep, _field_faults(F.col("_shot"), CONTRACT_DATASET, F.col("_at")))
    rows = shots.select(*keep, "_at", F.posexplode(_items(F.col("_shot"), "$.rows")).alias("_r", "_row"))
    rows = rows.withColumn("_at", F.concat("_at", at(".rows", "_r")))
    mark = F.try_variant_get("_row", "$.lastMedia", "double")
    whole = (mark >= 1) & (mark <= 10) & (F.abs(mark * 100 - F.round(mark * 100)) < 1e-6)
    odd = _fault(_KINDS[T.DoubleType][1](F.schema_of_variant(_part(F.col("_row"), "lastMedia"))) & ~whole,
                 F.concat("_at", F.lit(".lastMedia")), "not a mark from 1 to 10 in hundredths")
    in_rows = _listed(rows, keep, [*_field_faults(F.col("_row"), CONTRACT_ROW, F.col("_at")), odd])
    return top.unionByName(in_courses).unionByName(in_shots).unionByName(in_rows)


def sound_shortlists(raw: DataFrame, faults: DataFrame, owner: str) -> DataFrame:
    """The documents without a fault, for ``pages.read_shortlist``.

    Written, as the reader's checks would otherwise be pushed below the join and meet the others.
    """
    return cut_lineage(raw.join(faults.select(owner).distinct(), owner, "left_anti"))
