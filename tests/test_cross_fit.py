"""Designs on subsets of subjects against their SQL, on trials that are missing, alone at their end or without a rating."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chronaxis.operators import distributed as D
from chronaxis.plans import extra_queries as E
from chronaxis.plans import registry, study_queries  # noqa: F401  registers its queries
from chronaxis.sources import adapters as A

NAME = "ts13_cross_fitted_prior"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    rng = np.random.default_rng(7)
    rows = []
    for user in range(9):
        for video in ("click", "view", "purchase", "signup", "error", "other", "third"):
            if (user + len(video)) % 4 == 0 and user:
                continue  # no trial of this item
            n = 23 if (user, video) == (2, "view") else 19 if (user, video) == (5, "other") else int(rng.integers(1, 12))
            rows += [(user, video, t, float(rng.choice([0.0, 3.0, 3.0, rng.normal(60, 40)])), '{"k": %d}' % rng.integers(0, 4)) for t in range(n)]
    rows += [(20, "view", 0, 9.0, '{"k": 1}'), (21, "solo", 0, 4.0, '{"k": 2}'), (21, "solo", 1, 5.0, '{"j": 2}'), (2, "click", 11, 5.0, '{"j": 2}')]
    df = pd.DataFrame(rows, columns=["user_id", "event_type", "_t", "value", "props"])
    df["ts"] = (pd.Timestamp("2024-01-01") + pd.to_timedelta(df["_t"] * 3600, unit="s")).astype("datetime64[us]")
    df["event_id"] = np.arange(len(df))
    path = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.Table.from_pandas(df.drop(columns="_t"), preserve_index=False), path / "events.parquet")
    return str(path)


def by_sql(path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet')")
    return con.execute(registry.ORACLE[name]).fetchall()


def test_cross_fitted_prior_equals_its_sql(spark, odd):
    want = {r[:4]: r[4] for r in by_sql(odd, NAME)}
    for got in (registry.QUERIES[NAME](spark, odd), E.cross_fitted_prior(A.trace(spark, odd), 4)):
        rows = {tuple(r)[:4]: r[4] for r in got.collect()}
        assert set(rows) == set(want)
        assert {k for k, v in rows.items() if v is None} == {k for k, v in want.items() if v is None}
        assert all(v is None or abs(v - want[k]) < 2e-6 for k, v in rows.items())


def test_nested_selection_equals_its_sql(spark, odd):
    want = {r[0]: r[1:] for r in by_sql(odd, "cv5_nested_selection")}
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES["cv5_nested_selection"](spark, odd).collect()}
    assert set(got) == set(want)
    for k, row in got.items():
        assert row[:3] == pytest.approx(want[k][:3], abs=2e-6) and row[3] == want[k][3]


@pytest.mark.parametrize("width", [1.0, 100.0])
def test_medians_of_overlapping_sets(spark, width):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 300, p=[0.7, 0.28, 0.02]), "x": np.round(rng.normal(0, 3, 300), 1), "r": rng.integers(0, 6, 300)})
    sets = [[0, 1, 2], [2, 3], [5], [0, 1, 2, 3, 4, 5]]
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("a", None, 5), ("n", None, 2), (None, 4.0, 0)], "k string, x double, r long"))
    got = {(r["k"], r["set"]): (r["med"], r["rows"]) for r in D.medians_of_sets(df, ["k"], F.col("x"), "r", sets, width).collect()}
    want = {("n", s): (None, 1) for s in (0, 1, 3)} | {(None, s): (4.0, 1) for s in (0, 3)}
    for s, members in enumerate(sets):
        for k, g in pdf[pdf.r.isin(members)].groupby("k"):
            want[k, s] = (pytest.approx(g.x.median()), len(g) + (k == "a" and 5 in members))
    assert got == want
