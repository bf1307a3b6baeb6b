import glob
import os
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from palimpsest.session import builder

    session = builder("local[4]", 2).config("spark.driver.memory", "4g").config("spark.default.parallelism", "2").appName("tests").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def rows(frame, *columns):
    """The rows as sorted tuples."""
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr) if columns else sorted((tuple(r) for r in frame.collect()), key=repr)


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return value


def same(frame, oracle) -> None:
    """A Spark result and a DuckDB relation hold the same rows under the same names."""
    names = sorted(frame.columns)
    assert names == sorted(oracle.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)
    at = [oracle.columns.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in oracle.fetchall()), key=repr)
    assert ours == theirs
