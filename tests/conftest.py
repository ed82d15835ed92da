import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    return made


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            db.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return db


@pytest.fixture(scope="session")
def same():
    """Whether two frames hold the same rows and columns in any order."""

    def compare(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        assert len(a) == len(b)
        names = sorted(a.columns)
        a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (a, b))
        for c in names:
            assert (a[c].astype(object).where(a[c].notna(), None) == b[c].astype(object).where(b[c].notna(), None)).all() or a[c].equals(b[c]), c

    return compare
