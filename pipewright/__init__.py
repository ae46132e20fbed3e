"""pipewright: verb pipelines planned as Spark DataFrames."""

__version__ = "0.1.0"

from .emit import to_sql
from .engine import Engine
from .errors import PipelineError
from .fluent import tbl
from .plans.parser import parse

__all__ = ["Engine", "PipelineError", "parse", "tbl", "to_sql"]
