import re

import __spark_entry__
from pipewright.llm import queries


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_oracles_agree_on_the_smallest_tables(spark, duck):
    from ..conftest import SF, same_rows

    for name, sql in queries.ORACLE_SQL.items():
        got, want = same_rows(queries.QUERIES[name](spark, SF), duck.sql(sql))
        assert got == want, name
