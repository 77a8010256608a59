"""The driver's contract."""

import __spark_entry__ as entry


def test_names_and_oracles_match():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 60


def test_flagship_plan_reads_few_columns(spark, tmp_path):
    from lumenfold.queries import FLAGSHIP, Tables

    spark.createDataFrame([(1, 1, "F", 2000.0, "x")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, "n", "SEG")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    df = Tables(spark, str(tmp_path)).sql(FLAGSHIP)
    assert [tuple(r) for r in df.collect()] == [("SEG", 1, 2000.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan and "o_orderpriority" not in plan and "c_name" not in plan
