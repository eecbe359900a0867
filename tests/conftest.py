import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linkloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, **{"spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield session
    session.stop()
