"""One module for each family of verbs. A verb takes a state and returns the next."""

from ..plans import ast as A
from . import grouping, joins, rows, sets

HANDLERS = {
    A.Select: rows.select,
    A.Filter: rows.filter_,
    A.Mutate: rows.mutate,
    A.Rename: rows.rename,
    A.Arrange: rows.arrange,
    A.GroupBy: grouping.group_by,
    A.Summarise: grouping.summarise,
    A.Join: joins.join,
    A.SetOp: sets.set_op,
}
