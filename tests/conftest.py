import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same_rows(df, relation) -> tuple[list, list]:
    """Rows of a Spark frame and a DuckDB relation, in one order and with one order of columns."""
    import math

    def norm(row):
        return tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in row)

    names = relation.columns
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((norm(r) for r in df.collect()), key=key)
    want = sorted((norm(tuple(r[i] for i in place)) for r in relation.fetchall()), key=key)
    return got, want
