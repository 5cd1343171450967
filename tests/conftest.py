import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONHASHSEED", "0")


@pytest.fixture(scope="session")
def spark():
    from breachlens.session import local_session

    session = local_session(**{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    """A new scratch folder per test."""
    return tempfile.mkdtemp(prefix="run-")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
