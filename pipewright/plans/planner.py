"""Folds a pipeline's verbs over a state; the result is an ordinary lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..errors import PlanError
from . import ast as A
from .state import State


def plan(pipeline: A.Pipeline, table: Callable[[str], DataFrame]) -> DataFrame:
    """Each verb works on what the one before it gave. ``table`` finds frames by name; a pipeline without a source reads ``data``."""
    from ..operators import HANDLERS

    df = table(pipeline.source or "data")
    state = State(df, tuple(df.columns), table=table)
    for verb in pipeline.verbs:
        try:
            state = HANDLERS[type(verb)](state, verb)
        except AnalysisException as e:  # a column that doesn't exist, a type that doesn't fit
            raise PlanError(f"{type(verb).__name__.lower()}: {str(e).splitlines()[0]}") from e
    return state.result()
