import pytest

from meshframe.llm.common import prepare


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepare(spark)


@pytest.fixture
def docs_of(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make
