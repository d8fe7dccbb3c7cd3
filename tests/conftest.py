import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from plumbline.session import ship

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Run SQL over the tables of a data folder; gives column names and rows."""
    import os

    import duckdb

    def run(sf: str, sql: str):
        con = duckdb.connect()
        for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            path = f"{DATA}/{sf}/{name}.parquet"
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        found = con.execute(sql)
        return [c[0] for c in found.description], found.fetchall()

    return run


def plain(x):
    """A value in which both engines' results can be compared."""
    if isinstance(x, float):
        return None if x != x else float(f"{x:.9g}")
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    return x
