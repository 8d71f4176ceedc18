"""One trial owns a third of all rows: results still equal DuckDB, through the distributed forms."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from chronaxis.operators import align as Al
from tools.check import norm

QUERIES = ["src1_trace_index", "ag2_median_and_mad", "jn4_leave_one_out", "jn5_anchor_neighbours", "wn5_robust_z", "wn6_event_mask", "wn12_causal_ema", "wn14_monotone_projection",
           "wn16_ordinal_ranks", "sc4_bounded_anchor"]


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory):
    """900 rows: 300 in one trial, the rest over 12 subjects and 5 items, with many equal times."""
    rng = np.random.default_rng(11)
    n = 900
    hot = np.arange(n) % 3 == 0
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 20 * 86400, n) // 600 * 600, unit="s")
    df = pd.DataFrame({"event_id": np.arange(n), "ts": ts, "user_id": np.where(hot, 1, rng.integers(0, 12, n)),
                       "event_type": np.where(hot, "click", rng.choice(["click", "view", "purchase", "signup", "error"], n)),
                       "value": np.round(rng.exponential(50, n), 2), "props": [f'{{"k": {k}}}' for k in rng.integers(0, 100, n)]})
    folder = tmp_path_factory.mktemp("hot")
    pq.write_table(pa.Table.from_pandas(df.sort_values("ts").astype({"ts": "datetime64[us]"}), preserve_index=False), folder / "events.parquet")
    return str(folder)


@pytest.fixture(autouse=True)
def small_limits(monkeypatch):
    monkeypatch.setattr(Al, "LONG", 64)


@pytest.mark.parametrize("name", QUERIES)
def test_hot_trial(spark, hot_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{hot_dir}/events.parquet'")
    df = entry.queries()[name](spark, hot_dir)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    names = sorted(df.columns)
    want = sorted(tuple(norm(dict(zip(cols, r))[c]) for c in names) for r in cur.fetchall())
    assert sorted(tuple(norm(r.asDict(True)[c]) for c in names) for r in df.collect()) == want


def test_hot_trial_alignment_is_whole(spark, hot_dir, monkeypatch):
    from chronaxis.plans.timing_queries import signal_rows
    sig = signal_rows(spark, hot_dir).persist()
    keys = ["subject", "video", "axis"]
    cut = Al.seconds(Al.solve(sig, keys, Al.WarpSettings()), keys).toPandas().sort_values([*keys, "t"])
    monkeypatch.setattr(Al, "LONG", 1 << 16)
    whole = Al.seconds(Al.solve(sig, keys, Al.WarpSettings()), keys).toPandas().sort_values([*keys, "t"])
    assert len(cut) == 1800 and cut.w.tolist() == whole.w.tolist()
