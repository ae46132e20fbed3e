"""Window functions. They are partitioned by the pipeline's groups where the scope has any."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..plans import ast as A
from .registry import register


def _over(scope, order: Column | None, ties: bool = False, whole: bool = False):
    """The window: nulls last; without an order all rows tie, or stand as they came."""
    w = Window.partitionBy(*scope.partition) if scope.partition else Window.partitionBy()
    if order is not None:
        w = w.orderBy(order.asc_nulls_last())
    elif not whole:
        w = w.orderBy(F.lit(1) if ties else scope.arrival)
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if whole else w


@register("row_number", formals=("order",), window="position", order=None)
def _row_number(scope, order):
    return F.row_number().over(_over(scope, order)).cast("long")


@register("rank", formals=("order",), window="rank", order=None)
def _rank(scope, order):
    return F.rank().over(_over(scope, order, ties=True)).cast("long")


@register("dense_rank", formals=("order",), window="rank", order=None)
def _dense_rank(scope, order):
    return F.dense_rank().over(_over(scope, order, ties=True)).cast("long")


def _whole(node: A.Node, what: str) -> int:
    if not isinstance(node, A.Number) or not isinstance(node.value, int):
        raise ArgumentError(f"{what} must be a whole number")
    return node.value


@register("ntile", formals=("n", "order"), window="position", raw=("n",), order=None)
def _ntile(scope, n, order):
    return F.ntile(_whole(n, "ntile: n")).over(_over(scope, order)).cast("long")


def _shift(f):
    def build(scope, x, n, default, order_by):
        n = _whole(n, "the offset")
        moved = f(x, n).over(_over(scope, order_by))
        if default is None:
            return moved
        # The default may be any expression of the row: it stands where the window has no such row.
        there = f(F.lit(1), n).over(_over(scope, order_by)).isNotNull()
        return F.when(there, moved).otherwise(default)

    return build


for _name, _f in (("lead", F.lead), ("lag", F.lag)):
    register(_name, formals=("x", "n", "default", "order_by"), window="position", raw=("n",), n=A.Number("1"), default=None, order_by=None)(_shift(_f))


@register("first", "first_value", formals=("x", "order_by"), window="position", order_by=None)
def _first(scope, x, order_by):
    return F.first_value(x).over(_over(scope, order_by))


@register("last", "last_value", formals=("x", "order_by"), window="position", order_by=None)
def _last(scope, x, order_by):
    order = scope.arrival if order_by is None else order_by
    return F.last_value(x).over(_over(scope, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


@register("nth_value", formals=("x", "n", "order_by"), window="position", raw=("n",), order_by=None)
def _nth(scope, x, n, order_by):
    order = scope.arrival if order_by is None else order_by
    w = _over(scope, order)
    w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if order_by is None else w
    return F.nth_value(x, _whole(n, "nth_value: n")).over(w)
