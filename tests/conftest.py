import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logwarden.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events_of(spark):
    """Events from (timestamp, user, source_ip, message) tuples, numbered in order."""

    def build(rows):
        from datetime import datetime

        data = [
            (i, datetime.fromisoformat(ts) if ts else None, user, ip, message)
            for i, (ts, user, ip, message) in enumerate(rows, start=1)
        ]
        return spark.createDataFrame(
            data, "line_number BIGINT, timestamp TIMESTAMP_NTZ, user STRING, source_ip STRING, message STRING"
        )

    return build
