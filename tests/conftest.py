import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from shroud import config as C  # noqa: E402

TEST_SECRET = "test-surrogate-secret-deterministic"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from shroud.session import DEFAULT_CONF, QUERY_CONF, ensure_checkpoint_dir
    b = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
    for k, v in {**DEFAULT_CONF, **QUERY_CONF}.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def settings():
    return C.Settings(secret=TEST_SECRET)
