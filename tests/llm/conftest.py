import pytest
from llm_edges import EDGES


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from (doc_id, text) pairs, with extra columns whose names clash with results."""
    def make(rows, ddl="doc_id long, text string, score string, start string, piece string, part int, path string"):
        return spark.createDataFrame([(i, t, "x", "y", "z", 1, "p") for i, t in rows], ddl)
    return make


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(EDGES)


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of([])
