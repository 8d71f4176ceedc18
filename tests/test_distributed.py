"""Order primitives against brute force, with one key holding most rows and tiny chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronaxis.operators import distributed as D
from chronaxis.operators import donors as Dn
from chronaxis.operators import neighbours as N
from chronaxis.operators import priors as P
from chronaxis.operators import windows as Wn


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("hot", 400), ("b", 37), ("c", 1), ("d", 2)):
        values = np.round(rng.normal(60, 25, n), 1)
        rows += [(key, t, float(v)) for t, v in enumerate(values)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "x"])
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(5)


def col(df, name):
    return df.toPandas().sort_values(["k", "t"])[name].to_numpy()


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = D.quantiles(df, ["k"], F.col("x"), {"a": 0.025, "b": 0.5, "c": 0.9}, width=3.0).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        for name, p in (("a", 0.025), ("b", 0.5), ("c", 0.9)):
            assert got.loc[k, name] == pytest.approx(np.quantile(g.x, p), abs=1e-9)
        assert got.loc[k, "n"] == len(g)


def test_leave_one_out_medians(skewed):
    pdf, df = skewed
    got = D.leave_one_out_medians(df, ["k"], "x", "m", 4.0).toPandas().sort_values(["k", "t"])
    for (_, r) in got.iterrows():
        rest = pdf[(pdf.k == r.k) & (pdf.t != r.t)].x
        assert (np.isnan(r.m) and not len(rest)) or r.m == pytest.approx(np.median(rest))


def test_positions_match_row_number(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["hot"] * 8 + ["b"], 300), "o": rng.integers(0, 90, 300), "id": np.arange(300)})
    got = D.positions(spark.createDataFrame(pdf), ["k"], ["o", "id"], F.floor(F.col("o") / 10)).toPandas()
    want = pdf.sort_values(["o", "id"]).assign(t=lambda d: d.groupby("k").cumcount())
    assert dict(zip(got.id, got.t)) == dict(zip(want.id, want.t))


def test_dense_index_ints_and_strings(spark):
    ids = [3, 9, 9, 5000, 70000, 4096, 4097]
    got = D.dense_index(spark.createDataFrame([(i,) for i in ids], "s long"), "s", F.floor(F.col("s") / 4096)).toPandas()
    assert dict(zip(got.s, got.idx)) == {v: i for i, v in enumerate(sorted(set(ids)))}
    words = ["ab", "aa", "b", "ca"]
    got = D.dense_index(spark.createDataFrame([(w,) for w in words], "s string"), "s", F.substring("s", 1, 1)).toPandas()
    assert dict(zip(got.s, got.idx)) == {v: i for i, v in enumerate(sorted(words))}


def test_framed_equals_plain_window(skewed):
    pdf, df = skewed
    got = D.framed(df, ["k"], "t", 3, 2, lambda d, w: d.withColumn("m", F.avg("x").over(w.rowsBetween(-3, 2))), size=7)
    want = [g.x.iloc[max(0, i - 3): i + 3].mean() for _, g in pdf.sort_values(["k", "t"]).groupby("k") for i in range(len(g))]
    assert np.allclose(col(got, "m"), want)
    assert got.count() == len(pdf)


def test_running_sum_and_maximum(skewed):
    pdf, df = skewed
    pdf = pdf.sort_values(["k", "t"])
    assert np.allclose(col(D.running(df, ["k"], "t", F.col("x"), "s", "sum", size=9), "s"), pdf.groupby("k").x.cumsum())
    assert np.allclose(col(D.running(df, ["k"], "t", F.col("x"), "s", "max", size=9), "s"), pdf.groupby("k").x.cummax())


def test_attach_keeps_every_row(skewed):
    pdf, df = skewed
    tot = df.groupBy("k").agg(F.sum("x").alias("s"), (F.max("t") + 1).alias("n"))
    got = D.attach(df, tot, ["k"], size=16)
    assert got.count() == len(pdf)
    assert np.allclose(col(got, "s"), pdf.sort_values(["k", "t"]).groupby("k").x.transform("sum"))


def test_ranked_ordinal_and_average(skewed):
    pdf, df = skewed
    got = D.ranked(df, ["k"], F.col("x"), ["t"], 5.0, ordinal="o", average="a")
    pdf = pdf.sort_values(["k", "t"])
    assert np.allclose(col(got, "a"), pdf.groupby("k").x.rank(method="average"))
    assert np.allclose(col(got, "o"), pdf.groupby("k").x.rank(method="first"))
    down = D.ranked(df, ["k"], F.col("x"), ["t"], 5.0, descending=True, ordinal="o")
    assert np.allclose(col(down, "o"), pdf.groupby("k").x.rank(method="first", ascending=False))


@pytest.mark.parametrize("decay", [0.0, 0.3, 0.8, 0.95])
def test_ema_over_many_blocks(skewed, decay):
    pdf, df = skewed
    want = np.concatenate([g.x.ewm(alpha=1 - decay, adjust=False).mean() if decay else g.x for _, g in pdf.sort_values(["k", "t"]).groupby("k")])
    assert np.allclose(col(Wn.ema(df, ["k"], "x", decay, "e"), "e"), want, atol=1e-8)


def test_event_mask_takes_an_exact_count_on_a_flat_curve(spark):
    df = spark.range(60).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.lit(0.0).alias("g"))
    assert Wn.event_mask(df, ["k"], "g").filter("event").count() == 15


def test_chunks_drop_short_ends(spark):
    df = spark.range(11).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    got = Wn.chunks(df, ["k"], 5, 3).groupBy("chunk").agg(F.min("t").alias("a"), F.count(F.lit(1)).alias("n")).orderBy("chunk").collect()
    assert [(r.a, r.n) for r in got] == [(0, 5), (3, 5), (6, 5)]


def test_resample_hits_both_ends(spark):
    c = spark.createDataFrame([("a", t, float(t * t)) for t in range(5)], "v string, t long, x double")
    got = P.resample_phase(c, ["v"], spark.createDataFrame([("a", 9)], "v string, m long"), ["x"]).orderBy("i").toPandas()
    assert np.allclose(got.x, np.interp(np.linspace(0, 1, 9), np.linspace(0, 1, 5), np.arange(5.0) ** 2))


def test_neighbours_with_heavy_ties(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"v": "a", "s": np.arange(60), "x": rng.choice([1.0, 1.0, 1.0, 2.0, 2.5, 7.0], 60)})
    got = N.nearest_on_axis(spark.createDataFrame(pdf), ["v"], "x", "s", 4).toPandas()
    for _, r in got.iterrows():
        rest = pdf[pdf.s != r.s].assign(d=lambda d: (d.x - r.x).abs()).sort_values(["d", "s"]).head(4)
        assert [n["who"] for n in r.near] == rest.s.tolist()


def test_mean_distance_without_pairs(spark):
    rng = np.random.default_rng(3)
    q = pd.DataFrame({"g": rng.choice(["a", "b"], 50), "i": np.arange(50), "at": rng.normal(0, 3, 50)})
    p = pd.DataFrame({"g": rng.choice(["a", "a", "b"], 70), "o": np.round(rng.normal(0, 3, 70), 1)})
    got = Dn.mean_distance(spark.createDataFrame(q), spark.createDataFrame(p), ["g"], "at", "o").toPandas().set_index("i")
    for _, r in q.iterrows():
        assert got.loc[r.i, "distance"] == pytest.approx(np.abs(p[p.g == r.g].o - r["at"]).mean())


def test_null_keys_nulls_and_nan_equal_duckdb(spark):
    """Null keys are groups, nulls rank first, NaN is the largest value; ties and a tiny range of values included."""
    import duckdb
    rows = [(k, i, v) for i, (k, v) in enumerate(
        [("a", 1.0), ("a", 5.0), ("a", float("nan")), ("a", None), (None, 2.0), (None, 2.0), (None, float("inf")), (None, float("nan")), ("b", None)]
        + [("t", 3.0)] * 50 + [("s", j * 1e-9) for j in range(20)] + [("n", -float("inf")), ("n", -1.0)])]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE r (k VARCHAR, t BIGINT, x DOUBLE)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", rows)
    plain = lambda rs: sorted(str(tuple(r)) for r in rs)
    ranks = D.ranked(df, ["k"], F.col("x"), ["t"], average="mean").select("k", "t", F.col("rank").cast("long"), "mean").collect()
    want = con.execute("""SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY x NULLS FIRST, t),
        rank() OVER (PARTITION BY k ORDER BY x NULLS FIRST) + (count(*) OVER (PARTITION BY k, x) - 1) / 2 FROM r""").fetchall()
    assert plain(ranks) == plain(want)
    places = D.positions(df, ["k"], ["x", "t"], F.floor(F.col("x") * 0)).select("k", "t", F.col("t")).count()
    assert places == len(rows)
    middle = D.order_statistics(df, ["k"], F.col("x"), {"m": lambda n: F.floor((n - 1) / 2)}).select("k", "n", "m").collect()
    want = con.execute("""SELECT k, count(*), max(x) FILTER (WHERE p = (n - 1) // 2) FROM (
        SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x) - 1 AS p, count(*) OVER (PARTITION BY k) AS n FROM r WHERE x IS NOT NULL) GROUP BY k""").fetchall()
    assert plain(middle) == plain(want)
    ids = D.dense_index(df.select("k"), "k", F.substring("k", 1, 1)).collect()
    assert sorted((r["k"] or "", r["idx"]) for r in ids) == [("", 0), ("a", 1), ("b", 2), ("n", 3), ("s", 4), ("t", 5)]
    down = D.ranked(df.filter("k IS NULL"), ["k"], F.col("x"), ["t"], descending=True).orderBy("rank").collect()
    assert [str(r["x"]) for r in down] == ["nan", "inf", "2.0", "2.0"] and [r["t"] for r in down[2:]] == [4, 5]


@pytest.mark.parametrize("width", [1.0, 0.01])
def test_medians_without_folds(spark, width):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 400, p=[0.7, 0.28, 0.02]), "x": np.round(rng.normal(0, 3, 400), 1), "fold": rng.integers(0, 4, 400)})
    pdf.loc[pdf.k == "c", "fold"] = 2  # one side leaves nothing of this key
    sets = {"none": [], "0": [0], "2": [2], "13": [1, 3], "012": [0, 1, 2]}
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("a", None, 0)], "k string, x double, fold long"))
    got = {(r["k"], r["set"]): (r["med"], r["n"]) for r in D.medians_without(df, ["k"], F.col("x"), "fold", 4, sets, width).collect()}
    want = {}
    for name, out in sets.items():
        for k, g in pdf[~pdf.fold.isin(out)].groupby("k"):
            want[k, name] = (g.x.median(), len(g))
    assert got == {k: (pytest.approx(m), n) for k, (m, n) in want.items()} and ("c", "2") not in got


def test_medians_round_once(spark):
    """(a + b) / 2 of every pair, to the last bit: else equal ratings are no ties."""
    values = [1 + k * 254 / 99 for k in range(100)]
    pairs = [(i, x) for i, (a, b) in enumerate((a, b) for a in values for b in values[::7]) for x in (a, b)]
    got = D.quantiles(spark.createDataFrame(pairs, "k long, x double"), ["k"], F.col("x"), {"m": 0.5}).collect()
    assert {r["k"]: r["m"] for r in got} == {k: (pairs[2 * k][1] + pairs[2 * k + 1][1]) / 2 for k in range(len(pairs) // 2)}


def test_quantiles_at_one_rank_keep_infinite_values(spark):
    rows = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "x double")
    got = D.quantiles(rows, [], F.col("x"), {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    assert (got["low"], got["mid"], got["high"]) == (float("-inf"), 1.0, float("inf"))
