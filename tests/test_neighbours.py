"""Grid search for neighbours against comparing all pairs."""

import numpy as np
import pytest
from chronaxis.operators import neighbours as N


def plain(sources, targets, dims, k):
    out = {}
    for key, *at, me in targets:
        if any(v is None for v in at):
            continue
        rest = []
        for other, *x, who in sources:
            if other == key and who != me and all(v is not None for v in x):
                rest.append((abs(x[0] - at[0]) if dims == 1 else sum((a - b) * (a - b) for a, b in zip(x, at)) ** 0.5, who))
        out[key, me] = sorted(rest)[:k]
    return out


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("kind", ["even", "ties", "clusters"])
def test_grid_search_equals_all_pairs(spark, dims, kind):
    rng = np.random.default_rng(dims)
    n, axes = 150, [f"a{i}" for i in range(dims)]
    points = {"even": rng.uniform(0, 255, (n, dims)), "ties": rng.integers(1, 4, (n, dims)).astype(float),
              "clusters": rng.choice([0.0, 100.0, 1e4], (n, 1)) + rng.normal(0, 1e-3, (n, dims))}[kind]
    points[: n // 3] = points[0]  # one place holds a third of a key
    rows = [(("x", "y")[i % 5 == 0], *map(float, p), i) for i, p in enumerate(points)] + [("z", *[1.0] * dims, 900), ("x", *[None] * dims, 901)]
    schema = "key string, " + ", ".join(f"{a} double" for a in axes) + ", who long"
    df = spark.createDataFrame(rows, schema)
    far = [("x", *[-5e5] * dims, 700), ("y", *[3.0] * dims, 701)]  # targets that are no sources
    got = N.nearest_in_space(df, df.unionByName(spark.createDataFrame(far, schema)), ["key"], axes, "who", 7).collect()
    have = {(r["key"], r["who"]): [(s["distance"], s["who"]) for s in r["near"]] for r in got}
    want = plain(rows, rows + far, dims, 7)
    assert have.keys() == want.keys()
    for key in want:
        assert [w for _, w in have[key]] == [w for _, w in want[key]], key
        assert [d for d, _ in have[key]] == pytest.approx([d for d, _ in want[key]])


def test_no_sources(spark):
    schema = "key string, a double, who long"
    rows = spark.createDataFrame([("x", 1.0, 1)], schema)
    assert N.nearest_in_space(rows.filter("false"), rows, ["key"], ["a"], "who", 3).count() == 0
