"""The facade: tools that take JSON and give JSON envelopes, over the planner and the ranking operators."""

from __future__ import annotations

import datetime as dt
import decimal
import difflib
import inspect
import json
import math
import os
import time
import types
import typing
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from minnow import context
from minnow.catalog import TEXTUAL, Catalog
from minnow.errors import ArgumentError, EngineError, ExecutionError, NotSearchableError, QuerySpecError, ToolConfigError, UnknownToolError
from minnow.notes import TableNote, Term
from minnow.operators import retrieval
from minnow.operators.search import STRATEGIES, available, search_test, words_of
from minnow.plans.planner import Joins, Limits, Plan, Planner, Policy
from minnow.plans.spec import FORMATS, Filter, Measure, QuerySpec

TIERS = ("minimal", "standard")
MOST_QUESTION, MOST_BUDGET = 2000, 8000


def cell(value: Any, most: int) -> Any:
    """A value as strict JSON: dates as text, bytes by their number, no NaN, long text cut."""
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, decimal.Decimal):
        if not value.is_finite():
            return str(value)
        return int(value) if value == value.to_integral_value() and value.adjusted() < 1000 else float(value)
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, (dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return f"<{len(value)} bytes>"
    text = value if isinstance(value, str) else json.dumps(value, default=str)
    return text if len(text) <= most else text[:most] + "…"


@dataclass(frozen=True)
class Statement:
    """What the audit hook learns of an executed request: its shape and size, never a value of a filter or a row.

    rows is None where the request failed.
    """

    command: str
    shape: str
    values: int
    seconds: float
    rows: int | None


@dataclass(frozen=True)
class Switches:
    allow_metadata_writes: bool = False
    diagnose_empty_results: bool = True
    #: Whether answers show the shape of the request that was run, without values and scope.
    reveal_request: bool = False
    include_row_estimates: bool = True


@dataclass(frozen=True)
class Tool:
    """A tool of the host: schema is a JSON Schema of the arguments, handler takes them by name and gives a JSON object."""

    name: str
    description: str
    schema: dict
    handler: Callable[..., dict]
    tier: str = "standard"
    mutating: bool = False

    def __post_init__(self) -> None:
        if not self.name.isidentifier() or not self.description or self.tier not in (*TIERS, "full") or self.schema.get("type") != "object":
            raise ToolConfigError(f"{self.name!r} needs a name, a description, an object as schema and a tier")


def shape(spec: QuerySpec) -> str:
    """The request as JSON, its filters without their values."""
    return json.dumps({
        "table": spec.table, "columns": list(spec.columns), "filters": [[f.column, f.op] for f in spec.filters], "concepts": list(spec.concepts),
        "group_by": list(spec.group_by), "measures": [m.name for m in spec.measures], "order": [o.by for o in spec.order],
    })


def fits(value: Any, kind: Any) -> bool:
    """Whether a JSON value is of an annotated type."""
    origin, inner = typing.get_origin(kind), typing.get_args(kind)
    if kind is Any:
        return True
    if origin in (types.UnionType, typing.Union):
        return any(fits(value, k) for k in inner)
    if origin is list:
        return isinstance(value, list) and all(fits(v, inner[0]) for v in value)
    if kind is type(None):
        return value is None
    if kind is int:
        return isinstance(value, int) and not isinstance(value, bool)
    return isinstance(value, kind)


def called(tool: Callable[..., dict], name: str, arguments: Any) -> dict:
    """The tool's answer, after its arguments have been checked against its annotations."""
    if not isinstance(arguments, dict):
        raise ArgumentError(f"the arguments of {name} are a JSON object")
    known, kinds = inspect.signature(tool).parameters, typing.get_type_hints(tool)
    if not any(p.kind is p.VAR_KEYWORD for p in known.values()):
        for key, value in arguments.items():
            if key not in known:
                raise ArgumentError(f"{name} has no argument {key!r}", tuple(difflib.get_close_matches(str(key), known, 3, 0.5)))
            if not fits(value, kinds.get(key, Any)):
                raise ArgumentError(f"{name}: {key} is of the wrong type")
        if missing := [k for k, p in known.items() if p.default is p.empty and k not in arguments]:
            raise ArgumentError(f"{name} needs {missing[0]}")
    return tool(**arguments)


def answered(version: Callable[[], str], tools: dict[str, Callable[..., dict]], name: str, arguments: Any) -> dict:
    """The tool's answer in an envelope, or an error with suggestions; nothing is raised for a bad request."""
    try:
        if name not in tools:
            raise UnknownToolError(f"unknown tool {name!r}", tuple(tools))
        try:
            return {"schema_version": version()} | called(tools[name], name, arguments)
        except (PySparkException, Py4JError, RecursionError):
            raise ExecutionError("the request could not be run") from None
    except EngineError as e:
        return {"error": {"type": type(e).__name__, "message": str(e), "suggestions": list(e.suggestions)}}


def checked_format(format: str) -> None:
    if format not in FORMATS:
        raise QuerySpecError(f"unknown format {format!r}", FORMATS)


@dataclass
class Engine:
    spark: SparkSession
    catalog: Catalog
    policy: Policy = Policy()
    limits: Limits = Limits()
    scope: Callable[[str], tuple[Filter, ...]] = lambda table: ()
    concepts: dict[tuple[str, str], tuple[Filter, ...]] = field(default_factory=dict)
    measures: dict[tuple[str, str], Measure] = field(default_factory=dict)
    searchable: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Columns (table, name) whose words are compared as full text.
    fulltext: frozenset[tuple[str, str]] = frozenset()
    notes: dict[str, TableNote] = field(default_factory=dict)
    glossary: tuple[Term, ...] = ()
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None)
    #: Values that the index keeps of a column; 0, unless the index is asked for. And samples of a column with more.
    index_cap: int = 0
    index_samples: int = 3
    #: A folder of the driver where the value index is kept between sessions.
    cache_dir: str | Path | None = None
    #: Texts to vectors; it gets names and descriptions, never values of rows or hidden columns.
    embed: Callable[[list[str]], Sequence[Sequence[float]]] | None = None
    custom: tuple[Tool, ...] = ()
    switches: Switches = Switches()
    #: Called after every executed request; what it raises is not caught.
    audit: Callable[[Statement], None] | None = None

    def __post_init__(self) -> None:
        self._index: DataFrame | None = None
        self._usual: tuple[str, ...] | None = None
        self._vectors = context.Vectors(self.embed) if self.embed else None
        own = set(self.reading("standard"))
        if twice := [t.name for i, t in enumerate(self.custom) if t.name in own or t.name in {x.name for x in self.custom[:i]}]:
            raise ToolConfigError(f"there are two tools called {twice[0]}")

    @property
    def planner(self) -> Planner:
        return Planner(self.catalog, self.policy, self.limits, self.scope, self.concepts, self.measures, self.now)

    @property
    def cards(self) -> context.Cards:
        return context.Cards(self.catalog, self.policy, self.notes, self.glossary, self.concepts, self.measures, self.searchable, self.switches.include_row_estimates)

    @property
    def strategies(self) -> tuple[str, ...]:
        """Those of a search that names none."""
        if self._usual is None:
            self._usual = available(self.spark)
        return self._usual

    def refresh(self) -> Engine:
        """Forget what was read of the data: the value index is built anew at its next use."""
        self._index = None
        if self.cache_dir and self.cache_file().exists():
            self.cache_file().unlink()
        return self

    # Plans: lazy, without a limit.

    def plan_query(self, spec: dict | QuerySpec, separator: str = ".") -> Plan:
        return self.planner.plan(spec if isinstance(spec, QuerySpec) else QuerySpec.of(spec), separator=separator)

    def plan_search(self, table: str, term: str, columns: Iterable[str] = (), match: str = "all", strategies: Iterable[str] = (), limit: int | None = None) -> Plan:
        t = self.catalog.table(table)
        allowed = self.searchable.get(t.name, ())
        if not allowed:
            raise NotSearchableError(f"{t.name} has no searchable column", tuple(sorted(self.searchable)))
        asked = tuple(columns) or allowed
        if extra := [c for c in asked if c not in allowed]:
            raise NotSearchableError(f"{extra[0]} is not searchable", allowed)
        words = words_of(term, self.limits.max_search_tokens)

        def test(joins: Joins):
            return search_test({c: joins.resolve(c)[0] for c in asked}, words, tuple(strategies) or self.strategies, match, [c for c in asked if (t.name, c) in self.fulltext])

        return self.planner.plan(QuerySpec(t.name, limit=limit), test)

    # The value index.

    def indexed(self) -> dict[str, list[str]]:
        """Columns whose values are indexed: text that is neither hidden nor sensitive, of tables without a scope."""
        tables = self.catalog.tables.values() if self.index_cap else ()
        found = {t.name: [c.name for c in self.policy.usable(t) if c.kind in TEXTUAL] for t in tables if not self.scope(t.name)}
        return {t: columns for t, columns in found.items() if columns}

    def cache_file(self) -> Path:
        """Named by the structure of the catalog alone; what is indexed and how stands inside."""
        return Path(self.cache_dir or ".") / f"values-{self.catalog.fingerprint}.json"

    def cached(self, what: dict) -> list[list] | None:
        """Rows of the index kept for the same columns and settings; a file that cannot be read as that counts as none."""
        try:
            held = json.loads(self.cache_file().read_text(encoding="utf-8")) if self.cache_dir else {}
            rows = held["rows"] if held.get("what") == what else None
            kinds = (str, str, str, int, int, bool)
            return rows if rows is not None and all(len(r) == 6 and all(type(x) is k for x, k in zip(r, kinds, strict=True)) for r in rows) else None
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            return None

    def value_index(self) -> DataFrame:
        """Built at first use, one scan a table; it holds at most index_cap rows a column and then lives on the driver."""
        if self._index is None:
            columns = self.indexed()
            what = {"columns": columns, "cap": self.index_cap, "samples": self.index_samples}
            rows = self.cached(what)
            if rows is None:
                rows = []
                for t, names in columns.items():
                    found = retrieval.value_index(self.catalog.tables[t].frame, t, names, self.index_cap, self.index_samples)
                    rows += [list(r) for r in self.collected(found, "value_index", json.dumps({"table": t, "columns": names}), 0)]
                if self.cache_dir:
                    self.cache_file().parent.mkdir(parents=True, exist_ok=True)
                    part = self.cache_file().with_suffix(f".{os.getpid()}")
                    part.write_text(json.dumps({"what": what, "rows": rows}, ensure_ascii=False), encoding="utf-8")
                    part.replace(self.cache_file())
            self._index = self.spark.createDataFrame([tuple(r) for r in rows], retrieval.INDEX_SCHEMA)
        return self._index

    # Tools.

    def query(self, **spec: Any) -> dict:
        parsed = QuerySpec.of(spec)
        plan = self.planner.plan(parsed)
        out = self.fetched(plan, "query", shape(parsed), sum(len(f.value) if isinstance(f.value, tuple) else f.value is not None for f in parsed.filters))
        if not out["rows"] and self.switches.diagnose_empty_results:
            out["notes"] += self.diagnose(parsed)
        return out

    def search_rows(self, table: str, term: str, columns: list[str] | None = None, match: str = "all", strategies: list[str] | None = None, limit: int | None = None, format: str = "json") -> dict:
        checked_format(format)
        if limit is not None and limit < 1:
            raise QuerySpecError("limit is a whole number from 1")
        if unknown := [s for s in strategies or () if s not in STRATEGIES]:
            raise QuerySpecError(f"unknown strategy {unknown[0]!r}", STRATEGIES)
        plan = self.plan_search(table, term, columns or (), match, strategies or (), limit)
        used, name = list(strategies or self.strategies), self.catalog.table(table).name
        asked = json.dumps({"table": name, "columns": list(columns or ()), "match": match, "strategies": used})
        return self.fetched(plan, "search_rows", asked, len(words_of(term, self.limits.max_search_tokens))) | {"strategies": used, "searched": list(columns or self.searchable[name])}

    def list_tables(self, format: str = "json") -> dict:
        checked_format(format)
        return {"tables": [self.cards.summary(t) for t in self.catalog.tables.values()]}

    def describe_table(self, table: str, format: str = "json") -> dict:
        checked_format(format)
        return self.cards.card(self.catalog.table(table))

    def get_context(self, question: str, budget_tokens: int | None = None, format: str = "json") -> dict:
        """Tables that a question is about, by words, values and vectors, packed into a budget of 4-character tokens."""
        checked_format(format)
        if not 0 < len(question) <= MOST_QUESTION:
            raise QuerySpecError(f"a question has 1 to {MOST_QUESTION} characters")
        if budget_tokens is not None and not 1 <= budget_tokens <= MOST_BUDGET:
            raise QuerySpecError(f"budget_tokens is a number from 1 to {MOST_BUDGET}")
        hits = [r.asDict() for r in retrieval.value_match(self.value_index(), question).collect()] if self.index_cap else []
        cards, words = self.cards, context.tokens(question)
        terms = context.terms_of(words, self.glossary)
        tables, also, used = cards.pack(self.ranked(question, hits), budget_tokens or self.limits.context_budget_tokens)
        return {"tables": tables, "also": also, "values": [{k: h[k] for k in ("table", "column", "value")} for h in hits], "glossary": {t.name: t.text for t in terms}, "used_tokens": used}

    def ranked(self, question: str, hits: list[dict]) -> list[str]:
        """Tables for a question, the best first."""
        texts = {t.name: self.cards.texts(t) for t in self.catalog.tables.values()}
        rankings = {"words": context.by_words(context.tokens(question), texts), "values": list(dict.fromkeys(h["table"] for h in hits))}
        if self._vectors:
            rankings["vectors"] = self._vectors.nearest(question, {k: " ".join(x for x in parts.values() if x) for k, parts in texts.items()})
        return context.fused(rankings)

    def diagnose(self, spec: QuerySpec) -> list[str]:
        """For filters on text that found nothing: known values near those asked for."""
        if not self.index_cap:
            return []
        notes = []
        table = self.catalog.table(spec.table)
        for f in spec.filters:
            if f.op in ("eq", "in", "contains", "starts_with") and "." not in f.column and table.column(f.column).kind in TEXTUAL:
                for wanted in f.value if isinstance(f.value, tuple) else (f.value,):
                    near = [r["value"] for r in retrieval.nearest_values(self.value_index(), table.name, table.column(f.column).name, str(wanted)).collect()]
                    if near and wanted not in near:
                        notes.append(f"{f.column} has no {wanted!r}; near: {', '.join(near)}")
        return notes

    def collected(self, df: DataFrame, command: str, asked: str, values: int) -> list:
        """All rows of a bounded result; the audit hook is told, of failures too."""
        began, rows = time.perf_counter(), None
        try:
            rows = df.collect()
        except (PySparkException, Py4JError):
            raise ExecutionError("the query could not be run") from None
        finally:
            if self.audit:
                self.audit(Statement(command, asked, values, time.perf_counter() - began, None if rows is None else len(rows)))
        return rows

    def fetched(self, plan: Plan, command: str, asked: str, values: int) -> dict:
        rows = self.collected(plan.df.limit(plan.limit + 1), command, asked, values)
        most = self.limits.max_cell_chars
        out = {"columns": list(plan.columns), "rows": [[cell(v, most) for v in r] for r in rows[: plan.limit]], "truncated": len(rows) > plan.limit, "notes": list(plan.notes)}
        return out | ({"request": asked} if self.switches.reveal_request else {})

    def reading(self, tier: str) -> dict[str, Callable[..., dict]]:
        found: dict[str, Callable[..., dict]] = {"get_context": self.get_context, "query": self.query}
        if tier != TIERS[0]:
            found |= {"describe_table": self.describe_table, "list_tables": self.list_tables, "search_rows": self.search_rows}
        return found

    def tools(self, tier: str = "standard") -> dict[str, Callable[..., dict]]:
        """Tools of a tier by name; those of the host that change something are offered only where edits are allowed."""
        reached = TIERS[: TIERS.index(tier) + 1] if tier in TIERS else (*TIERS, "full")
        return self.reading(tier) | {t.name: t.handler for t in self.custom if t.tier in reached and (self.switches.allow_metadata_writes or not t.mutating)}

    def run(self, name: str, **arguments: Any) -> dict:
        """As dispatch, but errors are raised."""
        tools = self.tools()
        if name not in tools:
            raise UnknownToolError(f"unknown tool {name!r}", tuple(tools))
        return called(tools[name], name, arguments)

    def dispatch(self, name: str, arguments: dict[str, Any], tier: str = "standard") -> dict:
        return answered(lambda: self.catalog.fingerprint, self.tools(tier), name, arguments)

    def dispatch_text(self, name: str, arguments: dict[str, Any], tier: str = "standard") -> str:
        """The answer as text: as JSON, or in plain lines where the arguments ask for the compact format."""
        return as_text(self.dispatch(name, arguments, tier), arguments)


def as_text(answer: dict, arguments: Any) -> str:
    compact = isinstance(arguments, dict) and arguments.get("format") == "compact"
    return context.plain(answer) if compact else json.dumps(answer, ensure_ascii=False)
