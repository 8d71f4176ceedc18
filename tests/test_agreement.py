"""Agreement of two halves where a subject lacks one of them."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry


def test_a_subject_without_one_half_ranks_last(spark, tmp_path):
    rows = [(s, datetime.datetime(1992 + i, 3, 1), float(1 + (s * s + 7 * s * i) % 49)) for s in range(30) for i in range(7)
            if not (s in (3, 4) and i % 2 == 1) and not (s == 8 and i % 2 == 0)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double").write.parquet(path)
    got = entry.queries()["mt10_profile_agreement"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(entry.oracle_sql()["mt10_profile_agreement"])
    names = [d[0] for d in want.description]
    assert [[r[n] for n in names] for r in got] == [pytest.approx(list(r)) for r in want.fetchall()]
