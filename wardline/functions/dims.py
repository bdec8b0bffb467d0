"""Fixed values of the domain, and small dimension tables of them. Every table here is fixed: results depend on its values as they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Vital signs in display order, with unit, reference range and kind.
VITALS = [
    ("HR", "bpm", "60-160", "int"), ("ART_S", "mmHg", "70-140", "int"), ("ART_D", "mmHg", "40-90", "int"),
    ("ART_M", "mmHg", "50-110", "int"), ("CVP_M", "mmHg", "0-20", "int"), ("RAP_M", "mmHg", "0-20", "int"),
    ("SpO2", "%", "85-100", "int"), ("TSKIN", "Cel", "34.0-39.5", "float"), ("TRECT", "Cel", "34.0-39.5", "float"),
    ("rRESP", "/min", "5-60", "int"), ("EtCO2", "mmHg", "20-60", "int"), ("RR", "/min", "5-60", "int"),
    ("VTe", "mL", "50-800", "int"), ("VTi", "mL", "50-800", "int"), ("Ppeak", "cmH2O", "10-40", "int"),
    ("PEEP", "cmH2O", "3-12", "int"), ("O2conc", "%", "21-100", "int"), ("NO", "ppm", "0-40", "int"),
    ("BSR1", "%", "0-100", "int"), ("BSR2", "%", "0-100", "int"),
]
VITAL_NAMES = [v[0] for v in VITALS]
BEDS = ["BED01", "BED02", "BED03", "BED04", "BED05", "BED06"]
#: Observation codes other than the vital names themselves. "ICU_" and a vital's upper-case name is its code too.
CODES = {
    "8867-4": "HR", "2708-6": "SpO2", "8480-6": "NIBP_SYS", "8462-4": "NIBP_DIA", "8478-0": "NIBP_MEAN",
    "9279-1": "RR", "8310-5": "TEMP", "19935-6": "EtCO2", "60985-9": "CVP",
} | {f"ICU_{name.upper()}": name for name in VITAL_NAMES}
TOLERANCES = {
    "HR": 1.0, "ART": 1.0, "CVP": 1.0, "RAP": 1.0, "RR": 1.0, "EtCO2": 1.0, "SpO2": 1.0, "PEEP": 1.0, "NO": 1.0,
    "BSR": 1.0, "TSKIN": 0.1, "TRECT": 0.1, "VTe": 1.0, "VTi": 1.0, "Ppeak": 1.0, "O2conc": 1.0,
}
#: Readings outside these bounds are not accepted.
VALID_RANGES = {
    "TSKIN": (30.0, 45.0), "TRECT": (30.0, 45.0), "HR": (30.0, 250.0), "SpO2": (30.0, 100.0), "ART_S": (0.0, 250.0),
    "ART_D": (0.0, 250.0), "ART_M": (0.0, 250.0), "CVP_M": (0.0, 40.0), "RAP_M": (0.0, 40.0), "rRESP": (0.0, 80.0),
    "EtCO2": (0.0, 120.0), "RR": (0.0, 80.0), "VTe": (0.0, 2000.0), "VTi": (0.0, 2000.0), "Ppeak": (0.0, 80.0),
    "PEEP": (0.0, 40.0), "O2conc": (0.0, 100.0), "NO": (0.0, 100.0), "BSR1": (0.0, 100.0), "BSR2": (0.0, 100.0),
}
TEMPERATURES = ["TSKIN", "TRECT"]
DECIMAL_DISPLAY = ["TSKIN", "TRECT", "TEMP"]
INTEGER_PREFERRED = ["HR", "SpO2", "RR", "rRESP", "EtCO2", "Ppeak", "PEEP", "O2conc", "NO", "BSR1", "BSR2"]
ALLOWED_CHARACTERS = {"TSKIN": "0123456789.", "TRECT": "0123456789.", "CVP_M": "0123456789.-", "RAP_M": "0123456789.-"}
DEFAULT_CHARACTERS = "0123456789"
PATTERNS = {
    "TSKIN": r"^\d{2}(?:\.\d)?$", "TRECT": r"^\d{2}(?:\.\d)?$", "HR": r"^\d{1,3}$", "RR": r"^\d{1,3}$",
    "rRESP": r"^\d{1,3}$", "SpO2": r"^\d{1,3}$", "CVP_M": r"^-?\d{1,2}(?:\.\d+)?$", "RAP_M": r"^-?\d{1,2}(?:\.\d+)?$",
}
#: Random walk of the simulated sender: least, greatest, step.
WALKS = {
    "HR": (60, 160, 4), "ART_S": (60, 140, 6), "ART_D": (30, 90, 5), "ART_M": (40, 110, 5), "CVP_M": (0, 20, 2),
    "RAP_M": (0, 20, 2), "SpO2": (80, 100, 1), "TSKIN": (34.0, 39.5, 0.2), "TRECT": (34.0, 39.5, 0.2), "rRESP": (5, 60, 3),
    "EtCO2": (10, 60, 3), "RR": (5, 60, 3), "VTe": (0, 800, 40), "VTi": (0, 800, 40), "Ppeak": (5, 40, 2),
    "PEEP": (0, 15, 1), "O2conc": (21, 100, 3), "NO": (0, 40, 2), "BSR1": (0, 100, 4), "BSR2": (0, 100, 4),
}


def vital_dim(spark: SparkSession) -> DataFrame:
    rows = [(name, i, unit, *map(float, bounds.split("-")), kind) for i, (name, unit, bounds, kind) in enumerate(VITALS)]
    return spark.createDataFrame(rows, "vital string, ord int, unit string, ref_lo double, ref_hi double, kind string")


def bed_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, i) for i, b in enumerate(BEDS)], "bed string, ord int")


def code_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list({**{v: v for v in VITAL_NAMES}, **CODES}.items()), "code string, vital string")


def range_dim(spark: SparkSession, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame([(v, float(a), float(b)) for v, (a, b) in (ranges or VALID_RANGES).items()], "vital string, lo double, hi double")


def tolerance_dim(spark: SparkSession, tolerances: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame([(v, float(t)) for v, t in (TOLERANCES if tolerances is None else tolerances).items()], "vital string, tol double")


def pattern_dim(spark: SparkSession) -> DataFrame:
    rows = [(v, ALLOWED_CHARACTERS.get(v, DEFAULT_CHARACTERS), PATTERNS.get(v)) for v in VITAL_NAMES]
    return spark.createDataFrame(rows, "vital string, allowlist string, regex string")
