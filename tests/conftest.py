"""One Spark session for all tests."""

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from cadenza.plans.session import session

    spark = session("tests", cpus=8, memory="6g")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.stop()
