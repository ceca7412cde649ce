"""The declarative request: filters, measures, order. Shapes are checked here, names and kinds in the planner."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from minnow.errors import QuerySpecError

NAME = r"[A-Za-z_][A-Za-z0-9_]*"
PATH = re.compile(rf"{NAME}(\.{NAME})*\Z")


def is_scalar(x: Any) -> bool:
    return isinstance(x, (str, int, float))


def is_list(x: Any) -> bool:
    return isinstance(x, (list, tuple)) and len(x) > 0 and all(v is None or is_scalar(v) for v in x)


def is_count(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


@dataclass(frozen=True)
class Shape:
    """What the value of a filter looks like: a test, and words for those who get it wrong."""

    test: Callable[[Any], bool]
    words: str


ONE = Shape(is_scalar, "one scalar")
MANY = Shape(is_list, "a list of scalars")
TWO = Shape(lambda x: is_list(x) and len(x) == 2, "a list of two scalars")
NONE = Shape(lambda x: x is None, "no value")
DAYS = Shape(lambda x: is_count(x) and x >= 0, "a number of days from 0")

# The operators of filters with their values' shape, and the functions of measures with whether they need a column.
SHAPES = {
    "eq": ONE, "ne": ONE, "lt": ONE, "lte": ONE, "gt": ONE, "gte": ONE, "in": MANY, "not_in": MANY, "between": TWO, "contains": ONE, "starts_with": ONE,
    "is_null": NONE, "not_null": NONE, "since_days": DAYS,
}
NEEDS_COLUMN = {"count": False, "count_distinct": True, "sum": True, "avg": True, "min": True, "max": True, "measure": True}
OPERATORS, FUNCTIONS, DIRECTIONS = tuple(SHAPES), tuple(NEEDS_COLUMN), ("asc", "desc")
FORMATS = ("json", "compact")


def expect(ok: bool, message: str, known: tuple[str, ...] = ()) -> None:
    if not ok:
        raise QuerySpecError(message, known)


def one_of(value: Any, known: tuple[str, ...], what: str) -> None:
    expect(isinstance(value, str) and value in known, f"unknown {what}: {value!r}", known)


def path(value: Any, what: str) -> None:
    expect(isinstance(value, str) and bool(PATH.match(value)), f"{what} is a column or a dotted path, not {value!r}")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        path(self.column, "the column of a filter")
        one_of(self.op, OPERATORS, "operator")
        shape = SHAPES[self.op]
        expect(shape.test(self.value), f"{self.op} takes {shape.words}")
        if isinstance(self.value, list):
            object.__setattr__(self, "value", tuple(self.value))


@dataclass(frozen=True)
class Measure:
    fn: str
    column: str | None = None
    alias: str | None = None

    def __post_init__(self) -> None:
        one_of(self.fn, FUNCTIONS, "function")
        expect(self.column is not None or not NEEDS_COLUMN[self.fn], f"{self.fn} needs a column")
        if self.column is not None:
            path(self.column, "the column of a measure")
        if self.alias is not None:
            expect(isinstance(self.alias, str) and bool(re.fullmatch(NAME, self.alias)), f"an alias is a name, not {self.alias!r}")

    @property
    def name(self) -> str:
        return self.alias or "_".join([self.fn, *(self.column.split(".") if self.column else ())])


@dataclass(frozen=True)
class Order:
    by: str
    direction: str = "asc"

    def __post_init__(self) -> None:
        path(self.by, "what to order by")
        one_of(self.direction, DIRECTIONS, "direction")


@dataclass(frozen=True)
class QuerySpec:
    table: str
    columns: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    concepts: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None
    format: str = "json"

    def __post_init__(self) -> None:
        expect(isinstance(self.table, str), "the name of a table is a text")
        for part in ("columns", "group_by"):
            for x in getattr(self, part):
                path(x, f"an entry of {part}")
        for x in self.concepts:
            expect(isinstance(x, str), "the name of a concept is a text")
        expect(not (self.columns and self.aggregate), "columns go without group_by and measures; group columns are returned")
        outputs = [*dict.fromkeys(self.group_by), *(m.name for m in self.measures)]
        expect(len(outputs) == len(set(outputs)), "two outputs have one name")
        expect(self.limit is None or is_count(self.limit) and self.limit > 0, "limit is a whole number from 1")
        one_of(self.format, FORMATS, "format")

    @property
    def aggregate(self) -> bool:
        return bool(self.measures or self.group_by)

    @classmethod
    def of(cls, data: dict[str, Any]) -> QuerySpec:
        """From JSON; unknown keys are refused, lists have to be lists."""
        return build(cls, data)


#: Lists of a request: of texts, or of records of a class.
LISTS: dict[str, type] = {"columns": str, "filters": Filter, "concepts": str, "group_by": str, "measures": Measure, "order": Order}


def build(cls: type, data: Any):
    """A record of a class from a JSON object."""
    what, known = cls.__name__, {f.name: f for f in fields(cls)}
    expect(isinstance(data, dict), f"{what} is a JSON object")
    if extra := [k for k in data if k not in known]:
        raise QuerySpecError(f"{what}: unknown key {extra[0]!r}", tuple(difflib.get_close_matches(str(extra[0]), known, 3, 0.5)))
    if missing := [k for k, f in known.items() if k not in data and f.default is f.default_factory]:
        raise QuerySpecError(f"{what}: {missing[0]} is missing")

    def value(key: str, x: Any) -> Any:
        item = LISTS.get(key) if cls is QuerySpec else None
        if item is None:
            return x
        expect(x is None or isinstance(x, (list, tuple)), f"{what}: {key} is a list")
        return tuple(v if item is str or isinstance(v, item) else build(item, v) for v in x or ())

    return cls(**{k: value(k, x) for k, x in data.items()})
