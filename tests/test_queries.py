import pytest

from strataloom.plans import code_queries, problem_queries, star_queries

from .oracle import connect, same

WHERE = "/root/testdata/sf0.001"
ALL = {**star_queries.QUERIES, **code_queries.QUERIES, **problem_queries.QUERIES}
SQL = {**star_queries.SQL, **code_queries.SQL, **problem_queries.SQL}


@pytest.fixture(scope="module")
def duck():
    return connect(WHERE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, ALL[name], SQL[name], WHERE)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_runs(spark, name):
    assert ALL[name](spark, WHERE).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["src", "dst", "weight", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
