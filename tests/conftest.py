import os
import sys
from pathlib import Path

import duckdb
import pytest

TOP = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(TOP), str(TOP / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(TOP), os.environ.get("PYTHONPATH", "")])
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    def run(sql: str, sf: str):
        c = duckdb.connect()
        for f in (DATA / sf).glob("*.parquet"):
            c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        return c.sql(sql).df()

    return run
