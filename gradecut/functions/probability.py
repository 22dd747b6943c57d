"""Normal probabilities, bands and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradecut.params import Z_80

# Abramowitz and Stegun, formula 7.1.26.
_P = 0.3275911
_A1, _A2, _A3, _A4, _A5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429

# Band name and the lowest probability inside it, highest first.
BANDS = (("sigur", 0.9), ("probabil", 0.7), ("incert", 0.3), ("putin probabil", 0.1), ("improbabil", 0.0))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 1.5e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + x * _P)
    poly = F.lit(_A5)
    for coefficient in (_A4, _A3, _A2, _A1):
        poly = poly * t + coefficient
    erf = 1.0 - poly * t * F.exp(-(x * x))
    return 0.5 * (1.0 + F.when(z < 0, -1.0).otherwise(1.0) * erf)


def normal_cdf_value(z: float) -> float:
    """The same approximation for one plain number."""
    x = abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + x * _P)
    poly = _A5
    for coefficient in (_A4, _A3, _A2, _A1):
        poly = poly * t + coefficient
    erf = 1.0 - poly * t * math.exp(-(x * x))
    return 0.5 * (1.0 - erf) if z < 0 else 0.5 * (1.0 + erf)


def chance_band(probability: Column) -> Column:
    name, floor = BANDS[0]
    band = F.when(probability >= floor, name)
    for name, floor in BANDS[1:-1]:
        band = band.when(probability >= floor, name)
    return F.when(probability.isNotNull(), band.otherwise(BANDS[-1][0]))


def interval_low(centre: Column, sd: Column, z: float = Z_80) -> Column:
    return centre - sd * z


def interval_high(centre: Column, sd: Column, z: float = Z_80) -> Column:
    return centre + sd * z


def horizon_sd(step_sd: Column, target_year: Column, base_year: Column) -> Column:
    """Independent yearly steps add their variances."""
    return step_sd * F.sqrt((target_year - base_year).cast("double"))
