from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablepulse.session import local_session  # noqa: E402
from tests.freight_fixture import freight_rows  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def freight(spark):
    """The three freight tables with the seeded anomalies."""
    from tablepulse.sources import schemas, sinks

    rows = freight_rows()
    return {name: sinks.literal_batch(spark, rows[name], schemas.TABLES[name]).cache() for name in rows}


@pytest.fixture(scope="session")
def duck():
    import duckdb

    return duckdb.connect()
