"""Model constants, all overridable. Marks are on the 1..10 scale."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the published data contract.
SCHEMA_VERSION = 1
EPOCH_YEAR = 2023
MIN_YEAR, MAX_YEAR = 2000, 2100
COUNTY_PATTERN = "^[A-Z]{1,2}$"
TRACKS = ("teoretica", "tehnologica", "vocationala")
PROVENANCES = ("official", "synthetic")
MARK_MIN, MARK_MAX = 1.0, 10.0
MARK_MIN_H, MARK_MAX_H = 100, 1000
Z_80 = 1.2815515655446004
MAX_SAVED = 500

# Every county code the contract admits: 26 one-letter and 676 two-letter codes.
MAX_COUNTIES = 26 + 26 * 26
# Every mark a scale of integer hundredths can hold.
MAX_MARKS = MARK_MAX_H - MARK_MIN_H + 1


@dataclass(frozen=True)
class CutoffParams:
    """Year-over-year cutoff model."""

    sigma_prior: float = 0.25
    tau_prior: float = 0.2
    min_sd: float = 0.02
    mad_factor: float = 1.4826
    min_residuals: int = 8
    min_shifts: int = 3
    reliable_courses: int = 8
    z: float = Z_80
    # 'floored' keeps the prior floors on a short history; 'fixed_prior' is the older
    # estimator: tau is always the prior and sigma is whatever was observed.
    short_history: str = "floored"


@dataclass(frozen=True)
class CalibrationParams:
    """School record against exam mark; the grid step is in hundredths."""

    step_h: int = 25
    min_count: int = 150


@dataclass(frozen=True)
class EffectParams:
    """Shrunken school effects."""

    pseudo_count: int = 30
    min_n: int = 20


@dataclass(frozen=True)
class MarksParams:
    """Exam marks predicted from a school record."""

    drift_sd: float = 0.25
    exam_day_share: float = 0.45
    catalog_year_sd: float = 0.3
    record_years: int = 4
    subject_rho: float = 0.443
    mock_uplift: float = 0.35
    mock_sd: float = 0.45
    slope_half_step: float = 0.125
    first_grade: int = 5
    exam_grade: int = 8
    z: float = Z_80


# Measured calibration, 2025 exam session, 143,183 candidates.
# (school record, romana mean, romana sd, matematica mean, matematica sd)
KNOTS_2025 = (
    (6.0, 2.396, 0.943, 3.091, 1.245),
    (6.25, 2.643, 1.013, 3.171, 1.205),
    (6.5, 3.043, 1.104, 3.463, 1.186),
    (6.75, 3.371, 1.144, 3.58, 1.238),
    (7.0, 3.883, 1.248, 3.844, 1.277),
    (7.25, 4.352, 1.259, 4.058, 1.281),
    (7.5, 4.778, 1.283, 4.24, 1.293),
    (7.75, 5.254, 1.262, 4.488, 1.331),
    (8.0, 5.68, 1.229, 4.761, 1.351),
    (8.25, 6.151, 1.202, 5.1, 1.408),
    (8.5, 6.589, 1.167, 5.452, 1.438),
    (8.75, 7.063, 1.094, 5.895, 1.455),
    (9.0, 7.491, 1.033, 6.375, 1.461),
    (9.25, 7.925, 0.94, 6.918, 1.42),
    (9.5, 8.361, 0.821, 7.539, 1.322),
    (9.75, 8.815, 0.699, 8.253, 1.148),
    (10.0, 9.279, 0.515, 9.035, 0.82),
)

# School-code prefix to county.
COUNTY_BY_PREFIX = {
    "01": "AB", "02": "AR", "03": "AG", "04": "BC", "05": "BH", "06": "BN", "07": "BT",
    "08": "BV", "09": "BR", "10": "BZ", "11": "CS", "12": "CJ", "13": "CT", "14": "CV",
    "15": "DB", "16": "DJ", "17": "GL", "18": "GJ", "19": "HR", "20": "HD", "21": "IL",
    "22": "IS", "23": "IF", "24": "MM", "25": "MH", "26": "MS", "27": "NT", "28": "OT",
    "29": "PH", "30": "SM", "31": "SJ", "32": "SB", "33": "SV", "34": "TR", "35": "TM",
    "36": "TL", "37": "VS", "38": "VL", "39": "VN", "40": "B", "51": "CL", "52": "GR",
}

# County code to name.
COUNTY_NAMES = {
    "AB": "Alba", "AR": "Arad", "AG": "Argeș", "BC": "Bacău", "BH": "Bihor",
    "BN": "Bistrița-Năsăud", "BT": "Botoșani", "BV": "Brașov", "BR": "Brăila",
    "B": "București", "BZ": "Buzău", "CS": "Caraș-Severin", "CL": "Călărași",
    "CJ": "Cluj", "CT": "Constanța", "CV": "Covasna", "DB": "Dâmbovița", "DJ": "Dolj",
    "GL": "Galați", "GR": "Giurgiu", "GJ": "Gorj", "HR": "Harghita", "HD": "Hunedoara",
    "IL": "Ialomița", "IS": "Iași", "IF": "Ilfov", "MM": "Maramureș",
    "MH": "Mehedinți", "MS": "Mureș", "NT": "Neamț", "OT": "Olt", "PH": "Prahova",
    "SM": "Satu Mare", "SJ": "Sălaj", "SB": "Sibiu", "SV": "Suceava",
    "TR": "Teleorman", "TM": "Timiș", "TL": "Tulcea", "VS": "Vaslui",
    "VL": "Vâlcea", "VN": "Vrancea",
}
