import pytest

from hourwatt.operators import carbon
from hourwatt.plans.carbon import carbon_accounting
from hourwatt.sources.dimensions import load_emission_factors

FACTORS = {"direct": {"gas": 400.0, "wind": 0.0}}
SOURCES = ("gas", "wind")


def predictions(spark, rows):
    schema = "timestamp_utc string, window string, target string, model string, actual_mwh double, predicted_mwh double"
    return spark.createDataFrame(rows, schema).selectExpr("cast(timestamp_utc as timestamp) timestamp_utc", "window", "target", "model", "actual_mwh", "predicted_mwh")


FOUR = [
    ("2026-01-01T00:00:00Z", "test", "gas", "ridge", 10.0, 12.0),
    ("2026-01-01T00:00:00Z", "test", "wind", "ridge", 30.0, 28.0),
    ("2026-01-01T01:00:00Z", "test", "gas", "ridge", 20.0, 15.0),
    ("2026-01-01T01:00:00Z", "test", "wind", "ridge", 20.0, 25.0),
]


def test_four_rows(spark):
    out = carbon_accounting(predictions(spark, FOUR), FACTORS, SOURCES)
    first = out.hourly.orderBy("timestamp_utc").first()
    assert (first.actual_total_generation_mwh, first.predicted_total_generation_mwh) == (40.0, 40.0)
    assert (first.actual_total_emissions_kg_co2e, first.predicted_total_emissions_kg_co2e) == (4000.0, 4800.0)
    assert (first.actual_carbon_intensity_g_co2e_per_kwh, first.predicted_carbon_intensity_g_co2e_per_kwh) == (100.0, 120.0)
    gas = out.contributions.filter("source = 'gas'").orderBy("timestamp_utc").first()
    assert gas.actual_emissions_share == 1.0
    (metric,) = out.metrics.collect()
    assert metric.rows == 2 and metric.emissions_mae_kg_co2e == 1400.0
    assert out.summary.first().emissions_mae_kg_co2e == 1400.0


def test_zero_generation_has_no_intensity_and_negatives_count_as_zero(spark):
    rows = [
        ("2026-01-01T00:00:00Z", "w", "gas", "m", 0.0, 0.0), ("2026-01-01T00:00:00Z", "w", "wind", "m", 0.0, 0.0),
        ("2026-01-01T01:00:00Z", "w", "gas", "m", 10.0, 10.0), ("2026-01-01T01:00:00Z", "w", "wind", "m", 5.0, -5.0),
    ]
    zero, negative = carbon.hourly_carbon(predictions(spark, rows), FACTORS, SOURCES).orderBy("timestamp_utc").collect()
    assert zero.actual_carbon_intensity_g_co2e_per_kwh is None
    assert negative.predicted_wind_generation_mwh == 0.0 and negative.predicted_total_generation_mwh == 10.0
    shares = carbon.contributions(carbon.hourly_carbon(predictions(spark, rows), FACTORS, SOURCES), SOURCES)
    assert shares.filter("actual_emissions_share is null").count() == 2


def test_missing_parts_fail(spark):
    with pytest.raises(ValueError, match="missing factors"):
        carbon.hourly_carbon(predictions(spark, FOUR), {"m": {"gas": 1.0}}, SOURCES)
    with pytest.raises(ValueError, match="no generation values"):
        carbon_accounting(predictions(spark, FOUR[:1]), FACTORS, SOURCES)
    with pytest.raises(ValueError, match="missing required columns"):
        carbon.hourly_carbon(predictions(spark, FOUR).drop("model"), FACTORS, SOURCES)


def test_predictions_run_once(spark, tmp_path):
    # A source whose values are null has rows; a source of another (window, model) does not count for this one.
    rows = [(*r[:4], None, None) if r[2] == "wind" else r for r in FOUR]
    predictions(spark, rows).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    out = carbon_accounting(stored, FACTORS, SOURCES)
    for df in (out.hourly, out.contributions, out.metrics, out.summary):
        assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, out.hourly.collect())) == sorted(map(str, carbon.hourly_carbon(stored, FACTORS, SOURCES).collect()))
    other = predictions(spark, [*rows, ("2026-01-01T00:00:00Z", "test", "gas", "naive", 1.0, 1.0), ("2026-01-01T00:00:00Z", "later", "solar", "x", 1.0, 1.0)])
    assert [tuple(r) for r in carbon.missing_targets(other, SOURCES).collect()] == [("test", "naive", "wind")]
    with pytest.raises(ValueError, match="no generation values for source 'wind' in 'test' / 'naive'"):
        carbon_accounting(other, FACTORS, SOURCES)
    assert carbon_accounting(other, FACTORS, SOURCES, validate=False).hourly.count() == 3


def test_factor_file(tmp_path):
    table = load_emission_factors()
    assert set(table) == {"direct_operational_emissions", "lifecycle_emissions"}
    assert table["lifecycle_emissions"]["solar"] == 45.0 and len(table["direct_operational_emissions"]) == 8
    bad = tmp_path / "f.yaml"
    bad.write_text("methodologies: {}")
    with pytest.raises(ValueError):
        load_emission_factors(bad)
    bad.write_text("methodologies: {m: {emission_factors_kg_co2e_per_mwh: {}}}")
    with pytest.raises(ValueError):
        load_emission_factors(bad)
