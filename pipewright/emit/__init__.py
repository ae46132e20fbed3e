"""SQL text for a pipeline, in five dialects."""

from .dialects import DIALECTS, Dialect
from .flat import flat_sql
from .nested import spark_expression, spark_sql

__all__ = ["DIALECTS", "Dialect", "flat_sql", "spark_expression", "spark_sql", "to_sql"]


def to_sql(pipeline, dialect: str = "postgresql", schema=None) -> str:
    """``spark``: nested queries, verb by verb. The others: one flat SELECT."""
    return spark_sql(pipeline, schema) if dialect.lower() in ("spark", "sparksql") else flat_sql(pipeline, dialect)
