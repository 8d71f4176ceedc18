"""Registered queries against DuckDB on the small tables (TEST_ALL=1 runs every one)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, norm

SAMPLE = ["mt1_trial_macro_mae", "ag2_median_and_mad", "jn4_leave_one_out", "jn5_anchor_neighbours", "ts12_category_phase_prior", "ts13_cross_fitted_prior", "cv5_nested_selection",
          "flt4_decision_records", "flt6_rule_ablation", "dq2_record_violations", "dq7_graph_rules", "dq13_secret_scan", "jn17_record_linkage", "wn6_event_mask", "wn12_causal_ema",
          "ag18_variance_components", "bs6_reliability_bootstrap", "bs4_label_permutation", "cq21_identity_transfer", "ag13_subset_burden", "sc7_similarity_weights", "sg1_hjorth",
          "sm2_streaming_ema", "sm5_streaming_chunks", "sm6_streaming_sessions"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TEST_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    names = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert names == sorted(cols)
    want = sorted(tuple(norm(dict(zip(cols, r))[c]) for c in names) for r in cur.fetchall())
    got = sorted(tuple(norm(r.asDict(True)[c]) for c in names) for r in df.collect())
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
