"""Alignment on arrays of whole trials against the row by row form and against cut trials."""

import os

import numpy as np
import pytest

from chronaxis.operators import align as Al
from chronaxis.plans import timing_queries as Q

KEYS = ["k"]


def odd_trials(spark):
    """Trials of 1 to 30 seconds, among them constant ones, few values, a null and an infinite value."""
    rng = np.random.default_rng(4)
    rows = []
    for k, n in enumerate([1, 2, 3, 4, 5, 29, 30, 17, 17, 17, 17, 8]):
        x, y = rng.choice([1.0, 7.5, 255.0], n) if k % 3 else rng.exponential(50, n), rng.normal(100, 20, n)
        if k in (7, 8):
            x = np.full(n, 3.0)
        if k == 9:
            x = np.where(np.arange(n) == 5, 90.0, 3.0)  # MAD of zero, spread above it
        cells = [[k, t, float(a), float(b)] for t, (a, b) in enumerate(zip(x, y))]
        if k == 10:
            cells[4][2] = None
        if k == 11:
            cells[3][2] = float("inf")
        rows += cells
    return spark.createDataFrame(rows, "k long, t long, value double, prior double")


@pytest.mark.parametrize("s", [Al.WarpSettings(), Al.WarpSettings(radius=0), Al.WarpSettings(derivative=False)])
def test_signals_of_arrays_equal_columns(spark, s):
    rows = odd_trials(spark)
    packed = Al.signal_blocks(Al.trial_blocks(rows, KEYS), KEYS, s)
    got = Al.signal_seconds(packed, KEYS).toPandas().sort_values(["k", "t"])
    want = Al.signals(rows, KEYS, s).toPandas().sort_values(["k", "t"])
    assert got[["k", "t"]].values.tolist() == want[["k", "t"]].values.tolist()
    for c in "pm":
        np.testing.assert_allclose([x[0] for x in got[c]], [x[0] for x in want[c]], rtol=1e-12, atol=1e-12)


def test_cut_trials_decompose_as_whole_ones(spark, tmp_path, monkeypatch):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq
    rng = np.random.default_rng(3)
    n = 700
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 20 * 86400, n)), unit="s")
    df = pd.DataFrame({"event_id": np.arange(n), "ts": ts, "user_id": np.where(np.arange(n) % 3 == 0, 1, rng.integers(0, 8, n)),
                       "event_type": np.where(np.arange(n) % 3 == 0, "click", rng.choice(["click", "view"], n)),
                       "value": np.round(rng.exponential(50, n), 2), "props": [f'{{"k": {k}}}' for k in rng.integers(0, 100, n)]})
    pq.write_table(pa.Table.from_pandas(df.astype({"ts": "datetime64[us]"}), preserve_index=False), tmp_path / "events.parquet")

    def results(path):
        d = Q.decomposition(spark, path).drop("fold")
        parts = [d.join(Q.joint_lags(spark, path), Q.K2), Q.own_other(spark, path)]
        return [sorted(map(tuple, p.select(sorted(p.columns)).collect()), key=lambda r: tuple(map(str, r[-2:]))) for p in parts]

    whole = results(str(tmp_path))
    monkeypatch.setattr(Al, "LONG", 32)
    cut = results(os.path.join(str(tmp_path), "."))
    for a, b in zip(whole, cut):
        assert len(a) == len(b) > 10
        key = lambda r: [x for x in r if isinstance(x, (str, int))]
        for x, y in zip(sorted(a, key=lambda r: str(key(r))), sorted(b, key=lambda r: str(key(r)))):
            assert key(x) == key(y) and [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)])
