import pytest

from spliceflow.plans.registry import QUERIES, SQL


def rows(names, values):
    return sorted(str(tuple(v)) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    from conftest import DATA

    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert rows(names, got.select(names).collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
