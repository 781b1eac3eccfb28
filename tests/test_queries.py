import pytest

from lexweave.queries import corpus, reading, records, retrieval, training
from tests import oracle

CASES = [(m, name) for m in (training, retrieval, corpus, reading, records) for name in m.QUERIES]


@pytest.fixture(scope="module")
def con():
    if not oracle.DATA.exists():
        pytest.skip("no test data here")
    return oracle.database()


@pytest.mark.parametrize("module, name", CASES, ids=[n for _, n in CASES])
def test_query(spark, con, module, name):
    if name in module.SQL:
        oracle.same(spark, con, module.QUERIES[name], module.SQL[name])
    else:
        module.QUERIES[name](spark, str(oracle.DATA)).collect()


def test_names_are_distinct():
    names = [n for _, n in CASES]
    assert len(names) == len(set(names)) and all(set(m.SQL) <= set(m.QUERIES) for m, _ in CASES)
