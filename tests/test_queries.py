import pytest
from conftest import SMALL, same

from gneiss.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same(registry.queries()[name](spark, SMALL), SQL[name], SMALL)


def test_each_query_has_sql():
    assert set(registry.queries()) == set(SQL)


def test_sums_are_linear(spark):
    row = registry.queries()["hits_q30"](spark, SMALL).first()
    rows = registry.queries()["hits_q01"](spark, SMALL).first()["q1"]
    assert len(row) == 90
    assert all(row[k] == row[0] + k * rows for k in range(90))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_top_k_is_a_bounded_heap(spark):
    plan = registry.queries()["hits_q13"](spark, SMALL)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = registry.queries()["op_filter_gt"](spark, SMALL)._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,300000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert "ReadSchema: struct<>" in registry.queries()["op_count_star"](spark, SMALL)._jdf.queryExecution().toString()


def test_operator_queries_compare_some_rows(spark):
    from gneiss.plans import basics

    for name, query in basics.registered().items():
        if name != "op_limit_zero":
            assert query(spark, "/root/testdata/sf0.01").limit(1).count(), name
