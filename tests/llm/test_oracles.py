import pytest
from conftest import DATA, assert_same

from weftline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, duck, name):
    assert_same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLES[name])


def test_every_operator_is_registered():
    assert sorted({k.split("_")[0] for k in queries.QUERIES}) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])
