import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[4]").appName("tests")
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.driver.memory": "3g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-"),
        "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-warehouse-"),
    }
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" if os.path.isfile(f"{sf_dir}/{f}") else f"{sf_dir}/{f}/*.parquet"
        con.execute(f"create view {f.split('.')[0]} as select * from '{path}'")
    return con
