import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import helpers  # noqa: E402


@pytest.fixture(scope="module")
def documents(spark):
    def make(texts_or_rows):
        given = [r if isinstance(r, tuple) else None for r in texts_or_rows]
        data = given if all(given) and given else helpers.rows(texts_or_rows)
        return spark.createDataFrame(data, helpers.SCHEMA)

    return make


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], helpers.SCHEMA)
