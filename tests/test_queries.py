"""Queries against their SQL, over the provided tables."""

import pytest
from rows import canonical

import panelcast.catalog as catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: One of each kind at the size at which folds exist; all others at the smallest size are left to the driver.
CHECKED = [
    "E5_build_panel", "C3_asof_align", "C8_joint_returns", "C9_asof_forecast", "E6_label_window_calendar", "E11_purge", "B7_clip_standardise", "F4_ols_hac", "F6_screen_signals", "F14_crash_days", "G3_ols_factors", "G7_corrected_rho",
    "G16_score_function", "G17_product_attribution", "H5_forecast_trust", "H8_weight_breakdown", "J3_portfolio_path", "J5_backtest", "J10_relative", "K1_historical_var", "K2_var_breaches", "K5_bootstrap_tail", "L3_shocked_inputs", "L5_run_scenarios", "L5_input_changes",
    "D1_schema_errors", "D5_missing_rows", "D6_big_moves", "D7_drop_rebounds", "C2_joined", "N1_candles_week", "N3_downsample_minmax", "M8_portfolio_runs_table", "M13_rerun_changes", "P1_stream_candles", "A1_read_exports", "A2_settle_date_order", "A8_dataset_fingerprint", "J13_forecast_value", "J14_directional_window", "M16_direction_hit_rate",
]


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, oracle, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert canonical(got) == canonical(oracle(SQL[name], "sf0.01"))


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
