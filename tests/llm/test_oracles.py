import pytest

llm = pytest.importorskip("retromill.llm.queries")
from tests.test_oracles import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_llm(spark, sf, name):
    compare(spark, sf, llm.QUERIES, llm.ORACLES, name)
