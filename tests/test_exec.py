"""Every registered query against DuckDB, and the semantics that the tables can't show."""

import math

import pytest

from pipewright import Engine, queries, tbl
from pipewright.errors import ArgumentError, ParseError, PipelineError, PlanError, UnsupportedAggregate
from pipewright.plans.parser import parse
from pipewright.streaming import stream

from .conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, duck, name):
    got, want = same_rows(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name]))
    assert got == want


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, "magrittr")
    e.register("nulls", spark.createDataFrame([(1, 2.5, "a", 1), (2, 3.5, None, 1), (3, -2.5, "b ", 2), (None, 7.0, "É", 2)], "i int, d double, st string, g int"))
    e.register("zeros", spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (4.0, 2.0), (None, 0.0)], "a double, b double"))
    e.register("l", spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k int, v string"))
    e.register("r", spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "k int, v string"))
    e.register("da", spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "x int, y string"))
    e.register("db", spark.createDataFrame([(2, None), (3, "d")], "x int, y string"))
    e.register("empty", spark.createDataFrame([], "i int, d double, st string, g int"))
    e.register("ties", spark.createDataFrame([(1, 5), (1, 5), (1, 7), (2, 1)], "g int, v int"))
    e.register("dotted", spark.createDataFrame([(1, 2)], "`a.b` int, `select` int"))
    e.register("wide", spark.createDataFrame([tuple(range(60))], ", ".join(f"c{i} int" for i in range(60))))
    return e


def rows(engine, text):
    return [tuple(r) for r in engine.pipe(text).collect()]


def test_nulls_sort_last(engine):
    assert [r[0] for r in rows(engine, "nulls %>% select(i) %>% arrange(i)")] == [1, 2, 3, None]
    assert [r[0] for r in rows(engine, "nulls %>% select(i) %>% arrange(desc(i))")] == [3, 2, 1, None]
    assert {r[0]: r[1] for r in rows(engine, "nulls %>% mutate(r = rank(i)) %>% select(i, r)")}[None] == 4


def test_last_arrange_counts(engine):
    assert [r[0] for r in rows(engine, "nulls %>% arrange(i) %>% arrange(d) %>% select(d)")] == [-2.5, 2.5, 3.5, 7.0]


def test_strings(engine):
    got = rows(engine, "nulls %>% arrange(i) %>% select(p = paste0(st, i), q = paste(st, i, sep = '-'), n = nchar(st), t = str_trim(st), u = tolower(st), c = coalesce(st, 'none'))")
    assert got == [("a1", "a-1", 1, "a", "a", "a"), ("2", "2", None, None, None, "none"), ("b 3", "b -3", 2, "b", "b ", "b "), ("É", "É", 1, "É", "é", "É")]


def test_division(engine):
    got = rows(engine, "zeros %>% select(q = a / b)")
    assert got[0][0] == math.inf and got[1][0] == -math.inf and math.isnan(got[2][0]) and got[3][0] == 2.0 and got[4][0] is None


def test_logs(engine):
    got = rows(engine, "zeros %>% select(l = log(a), t = log10(a), b = log(a, 2))")
    assert got[0] == (0.0, 0.0, 0.0) and math.isnan(got[1][0]) and got[2][0] == -math.inf and got[3][2] == pytest.approx(2) and got[4] == (None, None, None)


def test_casts_and_types(engine):
    df = engine.pipe("nulls %>% select(a = as.integer(d), f = floor(d), s = sign(d), n = nchar(st), r = row_number(i))")
    assert dict(df.dtypes) == {"a": "int", "f": "double", "s": "int", "n": "bigint", "r": "bigint"}
    assert sorted(r[0] for r in df.collect()) == [-2, 2, 3, 7]


def test_substr(engine):
    assert rows(engine, "nulls %>% filter(i == 1) %>% select(a = substr('abc', 0, 2), b = substr('abc', -1, 2), c = substr('abc', 3, 2), d = substr('abc', 2, 9))") == [("ab", "ab", "", "bc")]


def test_ifelse_null_is_else(engine):
    assert [r[0] for r in rows(engine, "nulls %>% arrange(d) %>% select(x = ifelse(i > 1, 'y', 'n'))")] == ["y", "n", "y", "n"]
    assert rows(engine, "nulls %>% filter(i == NA)") == []


def test_joins(engine):
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert engine.pipe("l %>% inner_join(r, by = 'k')").columns == ["k", "v.x", "v.y"]
    assert sorted(rows(engine, "l %>% inner_join(r, by = 'k')")) == [(2, "b", "x"), (2, "c", "x")]
    assert sorted(rows(engine, "l %>% left_join(r, by = 'k')"), key=key) == sorted([(1, "a", None), (2, "b", "x"), (2, "c", "x"), (None, "d", None)], key=key)
    assert sorted(rows(engine, "l %>% right_join(r, by = 'k')"), key=key) == sorted([(2, "b", "x"), (2, "c", "x"), (3, None, "y"), (None, None, "z")], key=key)
    assert sorted(rows(engine, "l %>% full_join(r, by = 'k')"), key=key) == sorted([(1, "a", None), (2, "b", "x"), (2, "c", "x"), (3, None, "y"), (None, "d", None), (None, None, "z")], key=key)
    assert sorted(rows(engine, "l %>% semi_join(r, by = 'k')")) == [(2, "b"), (2, "c")]
    assert sorted(rows(engine, "l %>% anti_join(r, by = 'k')"), key=key) == sorted([(1, "a"), (None, "d")], key=key)
    assert sorted(rows(engine, "l %>% inner_join(l, by = 'k') %>% select(k, v.x, v.y)")) == sorted([(1, "a", "a"), (2, "b", "b"), (2, "b", "c"), (2, "c", "b"), (2, "c", "c")])
    assert len(rows(engine, "l %>% inner_join(r, by = k < k)")) == 4
    with pytest.raises(PlanError):
        engine.pipe("l %>% inner_join(r, by = 'nope')")


def test_sets(engine):
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(rows(engine, "da %>% union(db)"), key=key) == sorted([(1, "a"), (2, None), (3, "c"), (3, "d")], key=key)
    assert rows(engine, "da %>% intersect(db)") == [(2, None)]
    assert sorted(rows(engine, "da %>% setdiff(db)")) == [(1, "a"), (3, "c")]
    assert sorted(rows(engine, "da %>% union(db) %>% filter(x > 2)")) == [(3, "c"), (3, "d")]
    with pytest.raises(PlanError, match="columns"):
        engine.pipe("da %>% union(nulls)")
    with pytest.raises(PlanError, match="Cast"):
        engine.pipe("da %>% select(x) %>% union(strings)") if engine.register("strings", engine.pipe("da %>% select(y)")) else None


def test_empty(engine):
    assert rows(engine, "empty %>% summarise(n = n(), s = sum(i), m = median(d), o = mode(st))") == [(0, None, None, None)]
    assert rows(engine, "empty %>% group_by(g) %>% summarise(n = n())") == []


def test_ties(engine):
    assert sorted(rows(engine, "ties %>% group_by(g) %>% mutate(r = rank(v), d = dense_rank(v), n = row_number(v))")) == [(1, 5, 1, 1, 1), (1, 5, 1, 1, 2), (1, 7, 3, 2, 3), (2, 1, 1, 1, 1)]
    assert rows(engine, "ties %>% summarise(m = mode(v))") == [(5,)]


def test_names(engine):
    assert rows(engine, "dotted %>% filter(a.b == 1) %>% select(z = a.b)") == [(1,)]
    assert len(engine.pipe("wide %>% mutate(" + ", ".join(f"d{i} = c{i} + 1" for i in range(60)) + ")").columns) == 120


def test_scope(engine):
    assert rows(engine, "nulls %>% select(st) %>% filter(i == 1)") == [("a",)]
    assert engine.pipe("nulls %>% select(st) %>% mutate(x = d)").columns == ["st", "x"]
    assert engine.pipe("nulls %>% select(d = i, i = d)").columns == ["d", "i"]
    assert rows(engine, "nulls %>% select(st) %>% group_by(g) %>% summarise(n = n()) %>% arrange(g)") == [(1, 2), (2, 2)]
    assert engine.pipe("nulls %>% select(-d, -g)").columns == ["i", "st"]
    assert rows(engine, "da %>% group_by(y) %>% select(x) %>% union(ones_x) %>% summarise(n = n())") == [(3,)] if engine.register("ones_x", engine.pipe("da %>% select(x)")) else None
    with pytest.raises(PlanError):
        engine.pipe("nulls %>% select(st) %>% rename(z = d)")
    assert engine.pipe("nulls %>% mutate(i = i + 1, j = i, i = 0)").columns == ["i", "d", "st", "g", "j"]
    with pytest.raises(Exception, match="nope"):
        engine.pipe("nulls %>% summarise(n = n()) %>% filter(nope > 1)")


def test_filters_reach_the_scan(spark):
    e = queries.engine(spark, SF)
    plan = e.pipe("lineitem %>% select(l_orderkey, l_quantity, l_tax) %>% filter(l_quantity > 49) %>% select(l_orderkey)")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_targets(engine):
    assert rows(engine, "ones <- nulls %>% filter(g == 1)") == rows(engine, "ones")
    engine.sql("nulls %>% filter(g == 2) -> twos")
    assert engine.sql("SELECT count(*) FROM twos").first()[0] == 2


def test_statements(engine, spark):
    assert engine.sql("-- note\nnulls %>% filter(g == 1);").count() == 2
    assert engine.sql("SELECT '(| a %>% b |)' AS x").first()[0] == "(| a %>% b |)"
    assert engine.sql("SELECT n FROM (| nulls %>% group_by(g) %>% summarise(n = n()) |) WHERE g = 1").first()[0] == 2
    assert engine.sql("SELECT l.v, q.n FROM l LEFT JOIN (| r %>% group_by(k) %>% summarise(n = n()) |) q ON l.k = q.k WHERE l.v = 'b'").first()[1] == 1
    assert engine.sql("SELECT count(*) FROM dplyr('nulls |> filter(g == 1)', 'native')").first()[0] == 2
    assert spark.sql("FROM values (1), (2) t(a) |> where a > 1").count() == engine.sql("FROM values (1), (2) t(a) |> where a > 1").count() == 1
    for bad in ("SELECT * FROM (| nulls %>% filter(g == 1)", "SELECT * FROM (| |)", "SELECT * FROM (| nulls |)", "SELECT * FROM (| filter(g == 1) %>% select(g) |)"):
        with pytest.raises(ParseError):
            engine.sql(bad)
    with pytest.raises(ParseError, match="one statement"):
        engine.sql("nulls %>% filter(g == 1); nulls %>% filter(g == 2)")


def test_spark_text_means_the_same(engine, spark):
    """The SQL that embedded pipelines become gives what the frames give."""
    for text in (
        "nulls %>% select(st) %>% filter(i == 1)",
        "nulls %>% mutate(i = i * 2, k = i + 1) %>% filter(k > 3)",
        "nulls %>% group_by(g) %>% mutate(r = rank(d)) %>% arrange(d)",
        "zeros %>% select(q = a / b, l = log(a), s = sign(a), f = floor(a))",
        "nulls %>% select(a = substr(st, 0, 1), p = paste(st, i), n = nchar(st), x = as.character(i))",
        "l %>% full_join(r, by = 'k')",
        "l %>% anti_join(r, by = 'k')",
        "da %>% union(db) %>% filter(x > 2)",
        "nulls %>% rename(z = d) %>% group_by(g) %>% summarise(m = median(z), mean(i))",
        "nulls %>% group_by(g) %>% filter(rank(d) == 1)",
    ):
        a, b = engine.pipe(text), spark.sql(engine.to_sql(text, "spark"))
        assert a.columns == b.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), text


def test_pipe_syntax(spark):
    e = Engine(spark)
    assert e.pipe_syntax == "magrittr"
    spark.conf.set("pipewright.pipeSyntax", "|>")
    assert e.pipe_syntax == "native"
    e.pipe_syntax = "%>%"
    assert e.pipe_syntax == "magrittr"
    e.pipe_syntax = None
    spark.conf.set("pipewright.pipeSyntax", "nope")
    with pytest.raises(PipelineError):
        _ = e.pipe_syntax
    assert e.sql("SELECT 1").first()[0] == 1
    e.pipe_syntax = "native"
    assert tuple(e.sql("SELECT pipe_syntax(), 'pipe_syntax()'").first()) == ("native", "pipe_syntax()")
    spark.conf.unset("pipewright.pipeSyntax")


def test_errors(engine):
    for bad, error in (("none %>% select(a)", PlanError), ("nulls %>% select(i, i)", PlanError), ("nulls %>% rename(z = nope)", PlanError), ("nulls %>% summarise(s = sd(d))", UnsupportedAggregate), ("nulls %>% summarise(s = sum())", ArgumentError), ("nulls %>% group_by(nope)", PlanError)):
        with pytest.raises(error):
            engine.pipe(bad)


def test_fluent(engine):
    nulls, r = engine.catalog.table("nulls"), engine.catalog.table("r")
    got = tbl(nulls).filter("d > 0").mutate(x="d * 2").group_by("g").summarise(n="n()", s="sum(x)").arrange("-g").df
    assert [tuple(x) for x in got.collect()] == [(2, 1, 14.0), (1, 2, 12.0)]
    assert tbl(nulls).select("i", e="d + 1").df.columns == ["i", "e"]
    assert tbl(nulls).rename(k="i").semi_join(r, "k").df.count() == 2
    assert tbl(r).inner_join(tbl(nulls), "k == i").df.count() == 2
    assert tbl(r).union(r).df.count() == 3 and tbl(r).setdiff(r).df.count() == 0 and tbl(r).intersect(tbl(r)).df.count() == 3
    assert tbl(nulls).head(2).count() == 2


def test_stream(spark, tmp_path):
    source = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events.parquet*")
    df = stream(parse("filter(value > 0) %>% group_by(event_type) %>% summarise(n = n()) %>% arrange(event_type)"), source)
    query = df.writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    want = Engine(spark, "magrittr").load_dir(SF, ["events"]).pipe("events %>% filter(value > 0) %>% group_by(event_type) %>% summarise(n = n()) %>% arrange(event_type)")
    assert spark.table("streamed").collect() == want.collect()
    for bad in ("arrange(value)", "union(events)", "mutate(r = rank(value))"):
        with pytest.raises(PipelineError):
            stream(parse(bad), source)


def test_formats(spark, tmp_path):
    e = Engine(spark, "magrittr")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    for f in ("parquet", "orc", "json", "csv"):
        df.write.format(f).save(str(tmp_path / f))
        options = {"header": "false", "inferSchema": "true"} if f == "csv" else {}
        assert e.catalog.load(f"in_{f}", str(tmp_path / f), f, **options).count() == 2
    assert e.pipe("in_orc %>% filter(x > 1)").count() == 1
