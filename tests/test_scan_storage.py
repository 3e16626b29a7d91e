"""The scan runs one rule after another, so that no plan holds them all."""

import pytest

from storyloom.operators import rules
from storyloom.plans import bindings
from storyloom.plans.stored import stored_each


def test_the_scan_is_one_stored_table_of_all_rules(spark):
    g = bindings.event_graph(spark, "/root/testdata/sf0.001")
    asked = []
    wrap = lambda f: lambda g: asked.append(f) or f(g)
    all_rules = list(rules.RULES)
    rules.RULES[:] = [wrap(f) for f in all_rules]
    try:
        found = rules.scan(g)
    finally:
        rules.RULES[:] = all_rules
    assert asked == all_rules
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    got = {x.rule_order: x["count"] for x in found.groupBy("rule_order").count().collect()}
    want = {i: n for i in (0, 2, 4, 10) if (n := all_rules[i](g).count())}
    assert want and {i: got.get(i) for i in want} == want


def test_tables_stored_together_have_the_same_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([(2, None)], "a long, b string")
    assert sorted(map(tuple, stored_each(spark, (t for t in (a, b, a.where("a > 5")))).collect())) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError):
        stored_each(spark, [a, a.select("b", "a")])
