"""Measures as aggregate expressions, gated by the column's kind."""

from __future__ import annotations

from pyspark.sql import Column as Expr
from pyspark.sql import functions as F

from minnow.catalog import NUMERIC, ORDERED, Column, Kind
from minnow.errors import KindError

#: function: (aggregate, kinds it applies to).
AGGREGATES = {
    "count": (F.count, frozenset(Kind)), "count_distinct": (F.count_distinct, frozenset(Kind) - {Kind.JSON, Kind.OTHER}),
    "sum": (F.sum, NUMERIC), "avg": (F.avg, NUMERIC), "min": (F.min, ORDERED), "max": (F.max, ORDERED),
}


def aggregate(fn: str, c: Expr | None, column: Column | None) -> Expr:
    if c is None or column is None:
        return F.count(F.lit(1))
    function, kinds = AGGREGATES[fn]
    if column.kind not in kinds:
        raise KindError(f"{fn} does not apply to {column.name} ({column.kind})")
    return function(c)
