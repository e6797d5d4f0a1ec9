import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hubmetrics.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    """A session that keeps all its shuffle partitions, so that small data spreads over several slices as well."""
    session = build_session("local[4]", 4, "tests")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
