"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parent.parent), os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from keyfold.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "6g",
           "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(shared / "warehouse")},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    """A value as something that can be compared and counted."""
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, bytes | bytearray | memoryview):
        return bytes(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(df, *columns):
    """Sorted rows as tuples."""
    out = [tuple(plain(r[c]) for c in (columns or df.columns)) for r in df.collect()]
    return sorted(out, key=repr)
