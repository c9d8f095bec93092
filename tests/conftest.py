import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mailquarry.session import local_session

    s = local_session("tests", cores="4", memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def same_rows(df, relation, digits=5):
    """Both hold the same rows under the same column names."""
    import math

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, bool):
            return int(v)
        if isinstance(v, float) or hasattr(v, "as_tuple"):
            return round(float(v), digits) + 0.0
        return v

    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    mine = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    theirs = sorted(([plain(r[i]) for i in at] for r in relation.fetchall()), key=str)
    assert mine == theirs
