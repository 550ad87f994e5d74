"""Queries over epochs give their oracle's rows where events have values of zero, below it, or none."""

import duckdb
import pytest

from hexaphase.plans import catalog

from .test_queries import rows_of

NAMES = ["continuity_reason", "epoch_axis", "discontinuities", "sliding_windows", "window_ids", "frame_grid", "hop_window_overlap", "gate_identity", "identity_quad", "record_quality", "delay_runs", "discarded_tail", "submit_gate"]


@pytest.fixture(scope="module")
def zeros(sf, tmp_path_factory):
    path = tmp_path_factory.mktemp("zeros")
    value = "CASE WHEN event_id % 4 = 0 THEN 0.0 WHEN event_id % 11 = 1 THEN -value WHEN event_id % 13 = 2 THEN NULL ELSE value END"
    duckdb.sql(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{sf}/events.parquet') TO '{path}/events.parquet' (FORMAT parquet)")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(name, spark, zeros):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet'")
    got, want = catalog.QUERIES[name](spark, str(zeros)).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert rows_of(got) == rows_of(want)
