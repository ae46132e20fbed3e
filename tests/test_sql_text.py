"""The SQL text of each dialect."""

import pytest

from pipewright import parse, to_sql
from pipewright.emit import spark_sql
from pipewright.errors import UnsupportedAggregate, UnsupportedFunction, UnsupportedOperation


def flat(text, dialect="postgresql"):
    return to_sql(parse(text), dialect)


def value(text, dialect="postgresql"):
    return flat(f"t %>% select(x = {text})", dialect).split("\n")[0].removeprefix("SELECT ").rpartition(" AS ")[0]


def test_clauses():
    assert flat("select(name, age, salary) %>% filter(age > 18) %>% arrange(desc(salary))") == 'SELECT "name", "age", "salary"\nFROM "data"\nWHERE ("age" > 18)\nORDER BY "salary" DESC'
    assert flat("t") == 'SELECT *\nFROM "t"'
    assert flat("t %>% filter(a > 1) %>% filter(b == 'x')") == "SELECT *\nFROM \"t\"\nWHERE (\"a\" > 1) AND ((\"b\" = 'x'))"
    assert flat("t %>% group_by(g) %>% summarise(n = n(), m = mean(x))") == 'SELECT "g", COUNT(*) AS "n", AVG("x") AS "m"\nFROM "t"\nGROUP BY "g"'
    assert flat("t %>% mutate(b = a + 1)") == 'SELECT *, ("a" + 1) AS "b"\nFROM "t"'
    assert flat("t %>% mutate(r = a / b) %>% select(k, r)") == 'SELECT "k", ("a" / "b") AS "r"\nFROM "t"'
    assert flat("t %>% union(u)") == 'SELECT *\nFROM "t"\nUNION SELECT * FROM "u"'
    assert flat("t %>% setdiff(u)").endswith('EXCEPT SELECT * FROM "u"')


def test_joins():
    assert flat("t %>% left_join(u, by = 'k')").endswith('LEFT JOIN "u" ON "t"."k" = "u"."k"')
    assert flat("t %>% full_join(u, by = a == b)").endswith('FULL JOIN "u" ON ("a" = "b")')
    assert flat("t %>% semi_join(u, by = 'k')", "duckdb").endswith('SEMI JOIN "u" ON "t"."k" = "u"."k"')
    assert flat("t %>% anti_join(u, by = 'k')", "sqlite").endswith('WHERE NOT EXISTS (SELECT 1 FROM "u" WHERE "t"."k" = "u"."k")')


@pytest.mark.parametrize(
    ("text", "dialect", "sql"),
    [
        ("paste0(a, 'x')", "sqlite", "(\"a\" || 'x')"),
        ("paste(a, b)", "sqlite", "(\"a\" || ' ' || \"b\")"),
        ("paste(a, b, sep = '-')", "duckdb", "CONCAT_WS('-', \"a\", \"b\")"),
        ("log(a)", "duckdb", 'LN("a")'),
        ("log(a, 2)", "mysql", "LOG(2, `a`)"),
        ("log10(a)", "postgresql", 'LOG("a")'),
        ("log10(a)", "duckdb", 'LOG10("a")'),
        ("str_detect(a, 'x')", "postgresql", "(\"a\" ~ 'x')"),
        ("str_detect(a, 'x')", "mysql", "REGEXP_LIKE(`a`, 'x')"),
        ("str_detect(a, 'x')", "duckdb", "regexp_matches(\"a\", 'x')"),
        ("nchar(a)", "mysql", "CHAR_LENGTH(`a`)"),
        ("nzchar(a)", "postgresql", '(LENGTH("a") > 0)'),
        ("substr(a, 2, 4)", "postgresql", 'SUBSTR("a", 2, ((4) - (2) + 1))'),
        ("as.integer(a)", "mysql", "CAST(`a` AS SIGNED)"),
        ("as.numeric(a)", "postgresql", 'CAST("a" AS DOUBLE PRECISION)'),
        ("as.character(a)", "sqlite", 'CAST("a" AS TEXT)'),
        ("ifelse(a > 1, 'x', 'y')", "postgresql", "CASE WHEN (\"a\" > 1) THEN 'x' ELSE 'y' END"),
        ("is.na(a)", "postgresql", '("a" IS NULL)'),
        ("2 * mod(a, b)", "postgresql", '(2 * ("a" % "b"))'),
        ("'it'", "postgresql", "'it'"),
        ("0.1", "postgresql", "0.1"),
        ("NA", "postgresql", "NULL"),
        ("TRUE", "sqlite", "TRUE"),
        ("row_number()", "postgresql", "ROW_NUMBER() OVER ()"),
        ("rank(a)", "postgresql", 'RANK() OVER (ORDER BY "a")'),
        ("lag(a, 2, 0, b)", "postgresql", 'LAG("a", 2, 0) OVER (ORDER BY "b")'),
        ("last(a, b)", "postgresql", 'LAST_VALUE("a") OVER (ORDER BY "b" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)'),
        ("ntile(4)", "postgresql", "NTILE(4) OVER ()"),
        ("coalesce(a, 0)", "postgresql", 'COALESCE("a", 0)'),
    ],
)
def test_expressions(text, dialect, sql):
    assert value(text, dialect) == sql


def test_quoting():
    assert value("`".replace("`", "'") + "o\\'k'") == "'o''k'"
    assert to_sql(parse("t %>% select(a.b)"), "mysql") == "SELECT `a.b`\nFROM `t`"


def test_windows_take_the_groups():
    assert flat("t %>% group_by(g) %>% mutate(r = rank(a))").startswith('SELECT *, RANK() OVER (PARTITION BY "g" ORDER BY "a") AS "r"')


@pytest.mark.parametrize(
    ("text", "dialect", "error"),
    [("t %>% rename(a = b)", "postgresql", UnsupportedOperation), ("t %>% select(x) %>% rename(a = x)", "duckdb", UnsupportedOperation), ("t %>% select(sqrt(a))", "sqlite", UnsupportedFunction), ("t %>% select(str_detect(a, 'b'))", "sqlite", UnsupportedFunction), ("t %>% summarise(m = median(a))", "postgresql", UnsupportedAggregate), ("t %>% summarise(s = sd(a))", "duckdb", UnsupportedAggregate), ("t", "oracle", UnsupportedOperation)],
)
def test_refusals(text, dialect, error):
    with pytest.raises(error):
        flat(text, dialect)


def test_duckdb_extras():
    assert flat("t %>% rename(new = old)", "duckdb") == 'SELECT * EXCLUDE ("old"), "old" AS "new"\nFROM "t"'
    assert "MEDIAN" in flat("t %>% summarise(m = median(a))", "duckdb")


def test_spark_text_is_sequential():
    sql = spark_sql(parse("t %>% group_by(g) %>% summarise(n = n()) %>% filter(n > 1)"))
    assert sql == "SELECT * FROM (SELECT `g`, COUNT(*) AS `n` FROM (SELECT * FROM `t`) AS q GROUP BY `g`) AS q WHERE (`n` > 1)"
