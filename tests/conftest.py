from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def shared_dir(tmp_path_factory):
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(shared_dir):
    from checks.compare_engines import local_session

    session = local_session("4", {"spark.checkpoint.dir": str(shared_dir)})
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """rows(schema, *tuples) -> DataFrame"""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)
