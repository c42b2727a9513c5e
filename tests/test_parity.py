import pytest
from parity import connection, same

from typolith import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql_oracle(spark, con, name):
    out = catalog.queries()[name](spark, SF)
    assert same(out, con, catalog.oracle_sql()[name]) is None
    assert out.limit(1).count()


def test_epsilon_graph_has_as_many_edges_as_the_mutual(spark):
    mutual = catalog.queries()["knn_mutual"](spark, SF).count()
    assert catalog.queries()["epsilon_edges"](spark, SF).count() == mutual // 2 > 500
