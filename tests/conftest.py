import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from sedgeline.session import session

    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables():
    return os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(tables):
    """DuckDB over the tables of a size, with views of their names."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(tables).glob("*.parquet"):
        source = str(p) if p.is_file() else f"{p}/*.parquet"
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def rows(frame):
    """The rows of a pandas frame in comparable form, columns by name."""
    import pandas as pd

    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if hasattr(v, "item"):
            v = v.item()
        return float(v) if isinstance(v, (int, float)) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)
