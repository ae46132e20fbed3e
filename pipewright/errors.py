"""What can go wrong, by stage. Every error has a code and, where one helps, a hint."""

from __future__ import annotations


class PipelineError(Exception):
    code = "E-INTERNAL"

    def __init__(self, message: str, *, at: int | None = None, hint: str | None = None):
        self.message, self.at, self.hint = message, at, hint
        super().__init__(f"[{self.code}] {message}" + (f" (at character {at})" if at is not None else "") + (f". {hint}" if hint else ""))


class LexError(PipelineError):
    code = "E-SYNTAX"


class ParseError(PipelineError):
    code = "E-SYNTAX"


class PlanError(PipelineError):
    code = "E-PLAN"


class UnsupportedError(PipelineError):
    code = "E-UNSUPPORTED"


class UnsupportedFunction(UnsupportedError):
    pass


class UnsupportedAggregate(UnsupportedError):
    pass


class UnsupportedOperation(UnsupportedError):
    pass


class ArgumentError(PipelineError):
    code = "E-ARGUMENT"


class LimitError(PipelineError):
    code = "E-INPUT-TOO-LARGE"
