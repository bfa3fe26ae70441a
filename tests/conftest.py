import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from {url: content}."""

    def make(contents, headers=None):
        rows = [(i, u, c, i, (headers or {}).get(u)) for i, (u, c) in enumerate(contents.items() if isinstance(contents, dict) else contents)]
        return spark.createDataFrame(rows, "file_id bigint, url string, content string, ord bigint, headers map<string,string>")

    return make
