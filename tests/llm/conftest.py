import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture
def docs(spark):
    """Columns beside the documented ones clash with names that operators use inside, two even with each other but for case."""
    spark.conf.set("spark.sql.caseSensitive", "true")
    from fixtures import documents, odd_rows

    yield documents(spark, odd_rows())
    spark.conf.unset("spark.sql.caseSensitive")
