import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(__file__)]

from session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(8)
    yield session
    session.stop()
