import __spark_entry__
from tremorscope.plans import catalog


def test_registry():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    # 63 singular directions are not for SQL; see test_frontier_of_embeddings_as_by_numpy
    assert set(catalog.QUERIES) - {"linear_frontier_embeddings"} == set(catalog.ORACLES)


def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert row.n_fit_attempts == 9 and row.instability_mean > 0
