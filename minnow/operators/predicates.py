"""Filters as Column expressions, gated by the column's kind."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column as Expr
from pyspark.sql import functions as F

from minnow.catalog import NUMERIC, ORDERED, TEMPORAL, TEXTUAL, Column, Kind
from minnow.errors import KindError, LimitExceededError
from minnow.plans.spec import Filter

#: Kinds whose values can be compared with a scalar of a request.
COMPARABLE = NUMERIC | TEXTUAL | TEMPORAL | {Kind.BOOLEAN}
LONG = 1 << 63
PARSERS = {Kind.DATE: dt.date, Kind.TIME: dt.time, Kind.DATETIME: dt.datetime}
SPARK_TYPE = {Kind.DATE: "date", Kind.TIME: "time"}


def number(column: Column, value: Any) -> Expr:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise KindError(f"{column.name} takes numbers")
    if isinstance(value, int) and not -LONG <= value < LONG or isinstance(value, float) and not math.isfinite(value):
        raise KindError(f"{column.name}: the number is out of range")
    return F.lit(value)


def literal(column: Column, value: Any) -> Expr:
    """value as a literal of the column's kind; text for dates is parsed here, so that Spark never fails on it."""
    kind = column.kind
    if kind not in COMPARABLE:
        raise KindError(f"{column.name} is {kind} and cannot be compared; use is_null or not_null")
    if value is None:
        raise KindError(f"{column.name}: null is no value to compare with; use is_null")
    if kind in NUMERIC:
        return number(column, value)
    if not isinstance(value, bool if kind is Kind.BOOLEAN else str):
        raise KindError(f"{column.name} takes {'true or false' if kind is Kind.BOOLEAN else 'text'}")
    if kind not in PARSERS:
        return F.lit(value)
    try:
        parsed = PARSERS[kind].fromisoformat(value)
    except ValueError:
        raise KindError(f"{column.name}: {value!r} is no {kind}") from None
    return F.lit(parsed.isoformat()).cast(SPARK_TYPE.get(kind, column.data_type))


def only(kinds: frozenset[Kind], column: Column, op: str) -> None:
    if column.kind not in kinds:
        raise KindError(f"{op} does not apply to {column.name} ({column.kind})")


def compared(test: Callable[[Expr, Expr], Expr], kinds: frozenset[Kind] = COMPARABLE):
    """An operator over one literal."""

    def of(c: Expr, column: Column, f: Filter, now: dt.datetime) -> Expr:
        only(kinds, column, f.op)
        return test(c, literal(column, f.value))

    return of


def like(test: Callable[[Expr, Expr], Expr]):
    """A test of lower-cased text."""

    def of(c: Expr, column: Column, f: Filter, now: dt.datetime) -> Expr:
        only(TEXTUAL, column, f.op)
        if not isinstance(f.value, str):
            raise KindError(f"{f.op} takes text")
        return test(F.lower(c), F.lit(f.value.lower()))

    return of


def inside(c: Expr, column: Column, f: Filter, now: dt.datetime) -> Expr:
    return c.isin(*(literal(column, x) for x in f.value))


def between(c: Expr, column: Column, f: Filter, now: dt.datetime) -> Expr:
    only(ORDERED, column, f.op)
    return c.between(*(literal(column, x) for x in f.value))


def since(c: Expr, column: Column, f: Filter, now: dt.datetime) -> Expr:
    only(frozenset({Kind.DATE, Kind.DATETIME}), column, f.op)
    try:
        start = now - dt.timedelta(days=f.value)
    except OverflowError:
        raise KindError("since_days goes back too far") from None
    text = start.date().isoformat() if column.kind is Kind.DATE else start.isoformat(sep=" ", timespec="seconds")
    return c >= F.lit(text).cast(column.data_type)


TESTS: dict[str, Callable[[Expr, Column, Filter, dt.datetime], Expr]] = {
    "eq": compared(lambda c, x: c == x), "ne": compared(lambda c, x: c != x),
    "lt": compared(lambda c, x: c < x, ORDERED), "lte": compared(lambda c, x: c <= x, ORDERED), "gt": compared(lambda c, x: c > x, ORDERED), "gte": compared(lambda c, x: c >= x, ORDERED),
    "in": inside, "not_in": lambda *a: ~inside(*a), "between": between, "contains": like(F.contains), "starts_with": like(F.startswith),
    "is_null": lambda c, *_: c.isNull(), "not_null": lambda c, *_: c.isNotNull(), "since_days": since,
}


def predicate(c: Expr, column: Column, f: Filter, now: dt.datetime, max_in: int = 100) -> Expr:
    if f.op in ("in", "not_in") and len(f.value) > max_in:
        raise LimitExceededError(f"{f.op} takes at most {max_in} values")
    return TESTS[f.op](c, column, f, now)
