import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from codescope.session import local_session, remove_scratch


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "4"})
    yield session
    remove_scratch(session)
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(df, *columns):
    """The rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
