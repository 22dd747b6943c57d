"""Core functions for use from SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gradecut.functions.probability import BANDS

_EXAM_AVERAGE = """
CREATE OR REPLACE TEMPORARY FUNCTION exam_average_h(romana_h BIGINT, matematica_h BIGINT, third_h BIGINT)
RETURNS BIGINT
RETURN CASE WHEN third_h IS NULL THEN (romana_h + matematica_h) DIV 2
            ELSE (romana_h + third_h + matematica_h) DIV 3 END"""

_NORMAL_CDF = """
CREATE OR REPLACE TEMPORARY FUNCTION normal_cdf(z DOUBLE) RETURNS DOUBLE
RETURN SELECT CASE WHEN z < 0 THEN 0.5D * (1 - erf) ELSE 0.5D * (1 + erf) END
FROM (SELECT 1 - ((((1.061405429D * t - 1.453152027D) * t + 1.421413741D) * t - 0.284496736D) * t
                  + 0.254829592D) * t * exp(-x * x) AS erf
      FROM (SELECT 1 / (1 + 0.3275911D * abs(z) / sqrt(2D)) AS t, abs(z) / sqrt(2D) AS x))"""


def register_functions(spark: SparkSession) -> None:
    """Register ``exam_average_h``, ``normal_cdf`` and ``chance_band`` for the session."""
    spark.sql(_EXAM_AVERAGE)
    spark.sql(_NORMAL_CDF)
    cases = " ".join(f"WHEN p >= {floor}D THEN '{name}'" for name, floor in BANDS[:-1])
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION chance_band(p DOUBLE) RETURNS STRING "
        f"RETURN CASE WHEN p IS NULL THEN NULL {cases} ELSE '{BANDS[-1][0]}' END"
    )
