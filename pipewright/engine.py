"""The engine: pipelines as frames, as whole statements, as a table function, inside SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .emit import to_sql
from .errors import ParseError, PipelineError, PlanError
from .plans import ast as A
from .plans.lexer import pipe_mode
from .plans.parser import VERBS, parse
from .plans.planner import plan
from .sources import Catalog, scan
from .sources.embedded import SYNTAX_FUNCTIONS, Segment, outside_quotes, tell_syntax, visible_ctes

SETTING = "pipewright.pipeSyntax"
_VERB = "|".join(sorted(VERBS))
_LEADING = re.compile(r"(?:\s+|--[^\n]*\n?|/\*.*?\*/)+", re.DOTALL)
_HEAD = re.compile(rf"^(?:[A-Za-z_.][\w.]*\s*<-\s*)?(?:(?:{_VERB})\s*\(|[A-Za-z_.][\w.]*\s*(?:%>%|\|>\s*(?:\(\s*\\|(?:{_VERB})\s*\()))")


class Engine:
    """Tables, the pipe syntax and the entry points of one session.

    The pipe syntax is that given here, else the session's ``pipewright.pipeSyntax``, else that of the
    environment, else magrittr.
    """

    def __init__(self, spark: SparkSession, pipe_syntax: str | None = None):
        self.spark, self.catalog = spark, Catalog(spark)
        self._own = pipe_mode(pipe_syntax) if pipe_syntax is not None else None

    # -------------------------------------------------------------- settings
    @property
    def pipe_syntax(self) -> str:
        return self._own or pipe_mode(self.spark.conf.get(SETTING, None))

    @pipe_syntax.setter
    def pipe_syntax(self, value: str | None) -> None:
        """None goes back to the session's or the environment's."""
        self._own = None if value is None else pipe_mode(value)

    # -------------------------------------------------------------- tables
    def register(self, name: str, df: DataFrame) -> Engine:
        self.catalog.bind(name, df)
        return self

    def load_dir(self, folder: str, names, format: str = "parquet") -> Engine:
        self.catalog.load_dir(folder, names, format)
        return self

    # -------------------------------------------------------------- pipelines
    def parse(self, text: str, pipe_syntax: str | None = None) -> A.Pipeline:
        return parse(text, pipe_mode(pipe_syntax) if pipe_syntax else self.pipe_syntax)

    def pipe(self, text: str, data: DataFrame | None = None, pipe_syntax: str | None = None) -> DataFrame:
        """The frame of a pipeline. ``data`` is what a pipeline that starts with a verb reads."""
        return self.run(self.parse(text, pipe_syntax), data)

    def run(self, pipeline: A.Pipeline, data: DataFrame | None = None) -> DataFrame:
        table = self.catalog.table if data is None else lambda name: data if name == "data" else self.catalog.table(name)
        df = plan(pipeline, table)
        if pipeline.target:
            self.register(pipeline.target, df)
        return df

    def to_sql(self, text: str, dialect: str = "postgresql", pipe_syntax: str | None = None) -> str:
        return to_sql(self.parse(text, pipe_syntax), dialect, self.catalog.columns)

    # -------------------------------------------------------------- statements
    def sql(self, text: str) -> DataFrame:
        """Run a statement: a pipeline, SQL with pipelines in it, or plain SQL, which goes to Spark as it is."""
        body = _LEADING.sub("", text, count=1) if _LEADING.match(text) else text
        body = body.rstrip().removesuffix(";").rstrip()
        if self._is_pipeline(body):
            if ";" in outside_quotes(body):
                raise ParseError("one statement at a time")
            return self.pipe(body)
        if any(f in text.lower() for f in SYNTAX_FUNCTIONS):
            body = text = tell_syntax(body, self.pipe_syntax)
        self.catalog.prepare(body)
        segments = scan(body)
        if not segments:
            return self.spark.sql(text)
        sql, at, views = "", 0, []
        try:
            for s in segments:
                sql += body[at : s.start]
                views.append(f"pipewright_{uuid.uuid4().hex}")
                self._embedded(s, sql).createTempView(views[-1])
                sql, at = f"{sql}(SELECT * FROM {views[-1]})", s.end
            return self.spark.sql(sql + body[at:])
        finally:
            if not re.match(r"\s*create\b.*?\bview\b", body, re.IGNORECASE | re.DOTALL):  # which would look them up again
                for view in views:
                    self.spark.catalog.dropTempView(view)

    @staticmethod
    def _is_pipeline(body: str) -> bool:
        """Spark has a |> of its own: such text is ours if a verb with arguments follows."""
        plain = outside_quotes(body)
        return bool(_HEAD.match(plain)) and ("%>%" in plain or "|>" in plain or bool(re.match(rf"(?:{_VERB})\s*\(", plain)))

    def _embedded(self, segment: Segment, before: str) -> DataFrame:
        """The frame of a pipeline inside a statement. ``before`` is the statement up to it: its CTEs go before tables of their names."""
        pipeline = self.parse(segment.text, segment.mode)
        if pipeline.target:
            raise PlanError("a pipeline inside SQL can't have a target")
        ctes = self._ctes(before)
        return plan(pipeline, lambda name: ctes[name.lower()] if name.lower() in ctes else self.catalog.table(name))

    def _ctes(self, before: str) -> dict[str, DataFrame]:
        """The frames of the CTEs that a pipeline behind ``before`` may name. While one is read, those before it stand as views."""
        found: dict[str, DataFrame] = {}
        hidden: list[tuple[str, DataFrame | None]] = []
        try:
            for cte in visible_ctes(before):
                df = self.spark.sql(cte.sql)
                found[cte.name] = df.toDF(*cte.columns) if cte.columns else df
                there = any(t.isTemporary and t.name.lower() == cte.name for t in self.spark.catalog.listTables())
                hidden.append((cte.name, self.spark.table(cte.name) if there else None))
                found[cte.name].createOrReplaceTempView(cte.name)
        finally:
            for name, old in reversed(hidden):
                if old is None:
                    self.spark.catalog.dropTempView(name)
                else:
                    old.createOrReplaceTempView(name)
        return found


__all__ = ["Engine", "PipelineError"]
