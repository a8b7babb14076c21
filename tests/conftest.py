import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("rivulet-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def readings(spark):
    """Build (series_id, ts, value) from minutes after midnight."""

    def make(rows, schema="series_id string, minute int, value double"):
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("* except (minute)", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, minute, 0) as ts")

    return make
