"""Plan-level rules for every registered query (checked on the physical
plan at the smallest scale factor): no cross joins, no row-at-a-time Python
UDFs, Python only in the generator hook (MapInPandas)."""

import re

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_joins_or_row_python(spark):
    from pairlens.plans import catalog
    problems = {}
    for name, q in catalog.queries().items():
        plan = _plan(q(spark, SF))
        bad = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                             "ArrowEvalPython", "FlatMapGroupsInPandas")
               if op in plan]
        if bad:
            problems[name] = bad
    assert not problems, problems


def test_generator_queries_use_map_in_pandas(spark):
    import __spark_entry__ as E
    for name in ("row_count_report", "substitute_paraphrase", "reuse_runs"):
        assert "MapInPandas" in _plan(E.queries()[name](spark, SF)), name
    # evaluations join the answers as stored: the generator isn't in the plan to be asked again
    for name in ("accuracy_by_dataset", "generate_dedup"):
        plan = _plan(E.queries()[name](spark, SF))
        assert "MapInPandas" not in plan and "_answers" in plan and "Join" in plan, name
    assert re.search(r"Join \[_ph#", _plan(E.queries()["row_count_report"](spark, SF)))


def test_documents_scans_are_pruned(spark):
    import __spark_entry__ as E
    for name in ("answer_to_label", "distinct_labels", "collapse_two_labels"):
        plan = _plan(E.queries()[name](spark, SF))
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
        assert schemas, name
        for s in schemas:
            assert s.count(":") < 5, (name, s)   # never all five documents columns
