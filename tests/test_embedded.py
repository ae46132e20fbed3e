"""Pipelines inside SQL mean what they mean as frames."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

from pipewright import queries
from pipewright.errors import PlanError
from pipewright.sources.embedded import visible_ctes

from .conftest import SF

MORE = [
    "customer %>% select(c_name) %>% mutate(b = c_acctbal * 2)",
    "customer %>% select(c_name) %>% select(c_name, c_nationkey)",
    "customer %>% select(c_name) %>% group_by(c_nationkey) %>% summarise(n = n())",
    "nation %>% select(k = n_nationkey) %>% filter(k > 3) %>% select(n_name)",
    "nation %>% inner_join(nation, by = n_nationkey == n_regionkey)",
]
PIPELINES = [text for text, _ in queries.PAIRS.values() if re.match(r"\w+ %>% ", text)] + MORE


@pytest.fixture(scope="module")
def engine(spark):
    return queries.engine(spark, SF)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("text", PIPELINES)
def test_both_ways(engine, spark, text):
    frame, embedded = engine.pipe(text), engine.sql(f"SELECT * FROM (| {text} |) AS q")
    assert embedded.columns == frame.columns and rows(embedded) == rows(frame)
    if "'" not in text:
        assert rows(engine.sql(f"SELECT * FROM pipeline('{text}')")) == rows(frame)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pipewright_")]


def test_ctes(engine):
    one = "WITH a AS (SELECT 1 AS x, 5 AS h UNION ALL SELECT 2, 6)"
    assert rows(engine.sql(f"{one} SELECT * FROM (| a %>% select(x) %>% filter(h > 5) |)")) == ["Row(x=2)"]
    assert rows(engine.sql(f"{one}, b AS (SELECT * FROM (| a %>% filter(x > 1) |)) SELECT * FROM (| b %>% mutate(y = x + h) |)")) == ["Row(x=2, h=6, y=8)"]
    # An inner CTE goes before an outer one of its name, and a CTE before a table.
    assert rows(engine.sql(f"{one} SELECT * FROM (WITH a AS (SELECT x + 10 AS x FROM a) SELECT * FROM (| a %>% filter(x > 11) |))")) == ["Row(x=12)"]
    assert rows(engine.sql("WITH nation AS (SELECT 7 AS n) SELECT * FROM (| nation %>% mutate(m = n) |)")) == ["Row(n=7, m=7)"]
    assert rows(engine.sql("SELECT count(*) AS c FROM (WITH nation AS (SELECT 7 AS n) SELECT * FROM nation) x JOIN (| nation %>% filter(n_nationkey < 3) |) y")) == ["Row(c=3)"]
    assert rows(engine.sql("WITH f(p, q) AS (SELECT 1, 'with z as (' ) SELECT * FROM (| f %>% select(q) |)")) == ["Row(q='with z as (')"]
    assert rows(engine.sql(f"{one} SELECT l.x FROM (| a %>% filter(x == 1) |) l JOIN (| a %>% semi_join(nation, by = x == n_nationkey) |) r ON l.x = r.x")) == ["Row(x=1)"]


def test_visible_ctes(engine, spark):
    assert visible_ctes("SELECT * FROM (") == []
    assert visible_ctes("WITH a AS (SELECT 1), b(x) AS (SELECT 2) SELECT * FROM ") == [("a", None, "SELECT 1"), ("b", ["x"], "SELECT 2")]
    assert [c.name for c in visible_ctes("WITH a AS (SELECT 1), b AS (SELECT * FROM ")] == ["a"]
    assert visible_ctes("SELECT * FROM (WITH a AS (SELECT 1) SELECT 1) x, ") == []
    assert [c.sql for c in visible_ctes("WITH RECURSIVE a AS (SELECT 1) SELECT * FROM ")] == ["WITH RECURSIVE a AS (SELECT 1) SELECT * FROM a"]
    # The views that CTEs stood as are what they were, and a CTE can hold others.
    assert engine.sql("SELECT count(*) AS n FROM nation").first().n == 25
    assert not any(t.name in ("a", "b", "f") for t in spark.catalog.listTables())
    assert rows(engine.sql("WITH a AS (WITH i AS (SELECT 3 AS x) SELECT x FROM i), b AS (SELECT * FROM (| a %>% mutate(y = x) |)) SELECT * FROM (WITH c AS (SELECT y FROM b) SELECT * FROM (| c %>% filter(y > 1) |))")) == ["Row(y=3)"]


def test_what_does_not_exist(engine):
    for text in ("nation %>% select(nope)", "nation %>% mutate(a = nope + 1)", "nation %>% filter(nope > 1)", "nation %>% mutate(a = sqrt(n_name, 2))"):
        with pytest.raises(Exception) as e:
            engine.sql(f"SELECT * FROM (| {text} |)").collect()
        assert "nope" not in text or isinstance(e.value, PlanError)


def test_created_views_last(engine, spark):
    engine.sql("CREATE OR REPLACE TEMP VIEW small AS SELECT * FROM (| nation %>% filter(n_nationkey < 2) |)")
    assert spark.table("small").count() == 2
    for t in spark.catalog.listTables():
        if t.name == "small" or t.name.startswith("pipewright_"):
            spark.catalog.dropTempView(t.name)


def test_the_entry_does_without_the_subpackage():
    """What the subpackage needs may be absent: the other queries stay."""
    root = Path(__file__).resolve().parent.parent
    for hidden in ("public_tokenizers", "pipewright.llm", "corpus_pipeline"):
        code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'flagship' in e.queries(), any(k.startswith('op1_') for k in e.queries()))"
        out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout.split()
        assert int(out[0]) >= len(queries.QUERIES) and int(out[1]) >= len(queries.ORACLE_SQL) and out[2] == "True"
        assert out[3] == str(hidden == "corpus_pipeline" and (root / "pipewright" / "llm").exists())
