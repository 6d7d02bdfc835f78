import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from gridhour.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", cores="8", extra={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g"}
    )
    yield session
    session.stop()
