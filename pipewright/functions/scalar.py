"""Scalar functions, all of them native Column expressions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from ..plans import ast as A
from .registry import register

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """Division as in R: by zero gives an infinity or NaN, never an error."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).when(a.isNotNull(), F.lit(NAN))
    at_zero = F.when(F.isnan(a), F.lit(NAN)).otherwise(at_zero)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def _log(x: Column, f) -> Column:
    x = x.cast("double")
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f(x))


# ------------------------------------------------------------------ numbers
def _plain(name: str, f, formals=("x",)):
    register(name, formals=formals)(lambda scope, *args: f(*args))


_plain("abs", F.abs)
_plain("sqrt", F.sqrt)
_plain("exp", F.exp)
_plain("sign", lambda x: F.signum(x).cast("int"))
for _name in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh"):
    _plain(_name, getattr(F, _name))
_plain("atan2", F.atan2, ("y", "x"))
_plain("mod", lambda a, b: a % b, ("x", "y"))
_plain("log10", lambda x: _log(x, F.log10))


@register("round", formals=("x", "digits"), raw=("digits",), digits=A.Number("0"))
def _round(scope, x, digits):
    negative = isinstance(digits, A.Unary) and digits.op == "-"
    number = digits.operand if negative else digits
    if not isinstance(number, A.Number) or not isinstance(number.value, int):
        raise ArgumentError("round: digits must be a whole number")
    return F.round(x, -number.value if negative else number.value)


def _kept_double(f):
    def build(scope, x):
        y = f(x)
        return y.cast("double") if isinstance(scope.type_of(x), (T.DoubleType, T.FloatType)) else y

    return build


register("floor", formals=("x",))(_kept_double(F.floor))
register("ceiling", "ceil", formals=("x",))(_kept_double(F.ceil))


@register("log", formals=("x", "base"), base=None)
def _log_base(scope, x, base):
    return _log(x, F.ln) if base is None else divide(_log(x, F.ln), _log(base, F.ln))


# ------------------------------------------------------------------ strings
@register("concat", "paste0", variadic=True)
def _concat(scope, *args):
    return F.concat_ws("", *(a.cast("string") for a in args))


@register("paste", formals=("sep",), variadic=True, sep=A.Text(" "))
def _paste(scope, sep, *args):
    joined = F.concat_ws("", args[0].cast("string"))
    out, any_ = joined, args[0].isNotNull()
    for a in args[1:]:
        # CONCAT_WS skips nulls, and takes a separator that differs from row to row.
        piece = a.cast("string")
        out = F.when(piece.isNull(), out).when(any_, F.concat(out, sep, piece)).otherwise(piece)
        any_ = any_ | a.isNotNull()
    return out


_plain("tolower", F.lower)
_plain("lower", F.lower)
_plain("str_to_lower", F.lower)
for _name in ("toupper", "touppercase", "upper", "str_to_upper"):
    _plain(_name, F.upper)
for _name in ("str_length", "nchar"):
    _plain(_name, lambda x: F.char_length(x.cast("string")).cast("long"))
_plain("nzchar", lambda x: F.char_length(x.cast("string")) > 0)
_plain("str_trim", F.trim)
_plain("trimws", F.trim)
_plain("str_detect", lambda s, p: F.rlike(s, p), ("string", "pattern"))


@register("substr", formals=("x", "start", "stop"), stop=None)
def _substr(scope, x, start, stop):
    first = F.greatest(start.cast("int"), F.lit(1))
    length = F.lit(2**31 - 1) if stop is None else F.greatest(stop.cast("int") - first + 1, F.lit(0))
    return F.substr(x, first, length)


# ------------------------------------------------------------------ casts, conditions, nulls
for _names, _type in ((("as.numeric", "as.double"), "double"), (("as.integer",), "int"), (("as.character",), "string"), (("as.logical",), "boolean")):
    for _name in _names:
        _plain(_name, lambda x, t=_type: x.cast(t))


@register("ifelse", formals=("test", "yes", "no"))
def _ifelse(scope, test, yes, no):
    return F.when(test, yes).otherwise(no)


@register("if_else", formals=("condition", "true", "false"))
def _if_else(scope, test, yes, no):
    return F.when(test, yes).otherwise(no)


_plain("is.na", lambda x: x.isNull())
register("coalesce", variadic=True)(lambda scope, *args: F.coalesce(*args))
_plain("replace_na", F.coalesce, ("x", "replace"))
_plain("na.replace", F.coalesce, ("x", "replace"))

