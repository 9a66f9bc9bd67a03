"""One session for all tests."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from lorequarry.session import build_session

    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = build_session("local[8]", "tests", spark_sql_shuffle_partitions="8", spark_driver_memory="6g", spark_local_dir=at, spark_checkpoint_dir=at + "/shared", spark_sql_warehouse_dir=at + "/warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
