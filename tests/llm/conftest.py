import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from redlake.session import local_session

    return local_session("tests", cores=4, partitions=4)


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as a table with extra columns whose names clash with results."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'x' as lang", "doc_id as n_words", "'z' as fp", "1 as shard", "'k' as kept")

    return make
