import pytest

from lexweave.llm import queries
from tests import oracle


@pytest.fixture(scope="module")
def con():
    if not oracle.DATA.exists():
        pytest.skip("no test data here")
    return oracle.database()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    if name in queries.SQL:
        oracle.same(spark, con, queries.QUERIES[name], queries.SQL[name])
    else:
        queries.QUERIES[name](spark, str(oracle.DATA)).collect()
