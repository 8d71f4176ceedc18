"""Plans of queries with many parts stay small."""

import __spark_entry__ as entry


def test_nested_stages_read_written_tables(spark, sf):
    """The parts of the staged selection are tables; its own plan only chooses and scores."""
    df = entry.queries()["cv6_nested_anchor_stages"](spark, sf)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 12
    assert df.agg({"trials": "sum"}).first()[0] > 0
