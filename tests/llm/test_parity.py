import pytest

from meshframe.llm import queries as q
from tests.parity import compare


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, q.QUERIES[name], q.ORACLES[name], "/root/testdata/sf0.001")


def test_all_eleven_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
