import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    """A value that Spark's and DuckDB's rows can be compared by."""
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="session")
def duck(sf_dir):
    """Runs SQL over the same tables; returns (columns, rows)."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def run(sql):
        got = con.execute(sql)
        return [d[0] for d in got.description], got.fetchall()

    return run


@pytest.fixture(scope="session")
def agree(duck):
    """Fails unless a DataFrame has the rows of an SQL query."""

    def check(df, sql):
        names, rows = duck(sql)
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in sorted(names)]
        want = sorted(repr(tuple(plain(r[k]) for k in at)) for r in rows)
        assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == want

    return check
