"""Derived power-mix measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwatt.functions.numeric import safe_divide


def _or_zero(name: str):
    return F.coalesce(F.col(name), F.lit(0.0))


def add_power_mix(df: DataFrame) -> DataFrame:
    """Renewable and fossil totals, shares of production, residual demand and supply gap."""
    renewable = _or_zero("wind_mwh") + _or_zero("solar_mwh") + _or_zero("hydro_mwh") + _or_zero("bioenergy_mwh")
    fossil = _or_zero("thermal_mwh") + _or_zero("gas_mwh") + _or_zero("coal_mwh") + _or_zero("oil_mwh")
    production, consumption = F.col("total_production_mwh"), F.col("consumption_mwh")
    return df.withColumns(
        {
            "renewable_mwh": renewable,
            "fossil_mwh": fossil,
            "renewable_share": safe_divide(renewable, production),
            "nuclear_share": safe_divide(F.col("nuclear_mwh"), production),
            "fossil_share": safe_divide(fossil, production),
            "residual_demand_mwh": consumption - _or_zero("wind_mwh") - _or_zero("solar_mwh"),
            "supply_demand_gap_mwh": production - consumption,
        }
    )
