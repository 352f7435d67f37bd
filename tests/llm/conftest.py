"""Tables for the tests of the operators on texts."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd import ODD, SF_DIR, documents  # noqa: E402

from aeromosaic import ship  # noqa: E402


@pytest.fixture(scope="session")
def shipped(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def odd(shipped):
    return documents(shipped, ODD)


@pytest.fixture(scope="session")
def nothing(shipped):
    return documents(shipped, [])


@pytest.fixture(scope="session")
def given(shipped):
    """The documents of the smallest given table, as a list."""
    rows = shipped.read.parquet(os.path.join(SF_DIR, "documents.parquet")).collect()
    return [(r["doc_id"], r["text"], r["lang"]) for r in rows]
