import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("the test tables are not there")
    return path


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


def _shown(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or str(v) in ("nan", "<NA>", "NaT"):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return str([_shown(x) for x in v])
    if isinstance(v, int | bool):
        return f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="session")
def same_rows():
    """Whether two pandas frames hold the same rows in any order, columns by name."""

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        rows = lambda f: sorted("|".join(_shown(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
        assert rows(a) == rows(b)

    return check
