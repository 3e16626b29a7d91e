"""The built graph is counted from stored tables, so that its plan does not hold all that led to them."""

from storyloom import queries


def test_plan_is_that_of_stored_tables(spark):
    df = queries.built_graph(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and len(plan) < 50_000
    assert df.where("kind = 'characters'").count() > 0
