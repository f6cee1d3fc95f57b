import pytest

from strataloom.llm import queries

from ..oracle import connect, same

WHERE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    same(spark, connect(WHERE), queries.QUERIES[name], queries.SQL[name], WHERE)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, WHERE).count() > 0


def test_columns_of_the_found_queries(spark):
    want = {"p4_found": ["snapshot_no", "module", "repo", "id"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "kind", "found_text"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, WHERE).columns == columns
