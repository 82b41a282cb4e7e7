import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagelake.session import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship(session)
    yield session


@pytest.fixture
def values(spark):
    """Values of one expression over single-column rows."""

    def run(inputs, make, dtype="string"):
        rows = [(i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, v {dtype}")
        return [r["out"] for r in df.select("i", make("v").alias("out")).orderBy("i").collect()]

    return run
