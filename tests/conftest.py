import logging
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from canvasser.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    session = local_session(cores="8", shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Rows under a DDL schema."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
