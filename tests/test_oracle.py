"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

from oracle_harness import compare

SF = "/root/testdata/sf0.001"


def test_all_queries_match_duckdb(spark):
    from pairlens.plans import catalog
    res = compare(spark, SF, list(catalog.queries()), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] is False}
    assert not bad, bad
    assert len(res) >= 24


def test_every_query_has_a_sql_twin():
    import __spark_entry__ as E
    from pairlens.plans import catalog
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["dataset", "language", "model", "prompt_type", "n_total", "n_correct", "accuracy"]
