"""Pipelines over streams: row verbs and grouped summarise work on a streaming frame as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import UnsupportedOperation
from ..plans import ast as A
from ..plans.planner import plan
from ..plans.state import windows_in


def check(pipeline: A.Pipeline) -> None:
    """Refuse what a stream can't do before the query starts."""
    aggregated = False
    for verb in pipeline.verbs:
        if isinstance(verb, A.Arrange) and not aggregated:
            raise UnsupportedOperation("a stream can be arranged only behind summarise")
        if isinstance(verb, A.SetOp):
            raise UnsupportedOperation(f"{verb.kind} needs whole tables, not a stream")
        if any(windows_in(x)[0] for x in verb.walk() if isinstance(x, A.Call)):
            raise UnsupportedOperation("a stream has no window functions over whole groups")
        aggregated |= isinstance(verb, A.Summarise)


def stream(pipeline: A.Pipeline, source: DataFrame, table=None, watermark: tuple[str, str] | None = None) -> DataFrame:
    """The streaming frame of a pipeline over ``source``; ``watermark`` is (column, delay)."""
    check(pipeline)
    frame = source.withWatermark(*watermark) if watermark else source
    name = pipeline.source or "data"
    return plan(pipeline, lambda n: frame if n == name or table is None else table(n))
