"""Small fixed dimensions: emission factors and regions."""

from __future__ import annotations

from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from hourwatt import constants as C

FACTOR_SECTION = "emission_factors_kg_co2e_per_mwh"
FactorTable = dict[str, dict[str, float]]


def load_emission_factors(path: str | Path | None = None) -> FactorTable:
    """Read methodology -> source -> factor from YAML; both levels must be non-empty."""
    import yaml

    text = Path(path).read_text("utf-8") if path else resources.files("hourwatt").joinpath("config/emission_factors.yaml").read_text("utf-8")
    document = yaml.safe_load(text)
    sections = document.get("methodologies") if isinstance(document, dict) else None
    if not sections:
        raise ValueError("the factor file defines no methodology")
    table: FactorTable = {}
    for name, section in sections.items():
        factors = (section or {}).get(FACTOR_SECTION)
        if not factors:
            raise ValueError(f"methodology {name!r} defines no emission factors")
        table[name] = {source: float(value) for source, value in factors.items()}
    return table


def factor_frame(spark: SparkSession, factors: FactorTable) -> DataFrame:
    """The factor table as rows (methodology, source, factor): methodologies times sources, a few dozen."""
    rows = [(m, s, f) for m, by_source in factors.items() for s, f in by_source.items()]
    return spark.createDataFrame(rows, "methodology string, source string, factor_kg_co2e_per_mwh double")


def region_frame(spark: SparkSession, national: bool = True) -> DataFrame:
    """Region, representative city and coordinates: twelve regions and the national row."""
    rows = [*C.REGIONAL_LOCATIONS, *([C.NATIONAL_LOCATION] if national else [])]
    return spark.createDataFrame(rows, "region string, city string, latitude double, longitude double")
