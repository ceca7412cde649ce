"""Metadata files: what people say about tables, columns, relationships, concepts, measures and terms.

One text file for each table under tables/, and project.md, relationships.md, glossary.md. A file has a
title line, `key: value` lines and `##` sections of bullets. Files that are read and written again stay
the same once they are in canonical form. apply() checks everything against a catalog.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from minnow.catalog import Catalog, ForeignKey, Relationship
from minnow.engine import Engine
from minnow.errors import EngineError, MetadataConflictError, MetadataError, UnknownColumnError
from minnow.notes import ColumnNote, TableNote, Term
from minnow.plans.planner import Planner, Policy
from minnow.plans.spec import Filter, Measure, QuerySpec, build

# The format's version, section names and flags.
FORMAT = "1"
SECTIONS = ("Description", "Columns", "Relationships", "Concepts", "Measures")
FLAGS = ("searchable", "fulltext", "sensitive", "hidden")
MOST_DISTINCT, MOST_SAMPLES = 1000, 10
#: What holds where project.md turns the value index on and says no more.
DISTINCT, SAMPLES = 200, 3

STEM = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?\Z")
BULLET = re.compile(r"- (?P<name>[^:\[\]]+?)(?: \[(?P<flags>[^\]]*)\])?:(?: (?P<text>.*))?\Z")
PAIR = re.compile(r"(?P<key>[a-z_]+):(?: (?P<value>.*))?\Z")
END = re.compile(r"(?P<table>[A-Za-z_][\w.]*) \((?P<columns>[^()]+)\)\Z")


@dataclass(frozen=True)
class Item:
    """A bullet: its name, flags, text and `key: value` lines below it."""

    name: str
    text: str = ""
    flags: tuple[str, ...] = ()
    more: tuple[tuple[str, str], ...] = ()

    def get(self, key: str) -> str:
        return dict(self.more).get(key, "")

    def with_(self, **more: str | None) -> Item:
        """The item with these lines; None leaves a line as it is, an empty text removes it."""
        kept = dict(self.more) | {k: v for k, v in more.items() if v is not None}
        return replace(self, more=tuple((k, v) for k, v in kept.items() if v))

    def lines(self) -> list[str]:
        flags = f" [{', '.join(self.flags)}]" if self.flags else ""
        return [f"- {self.name}{flags}: {self.text}".rstrip(), *(f"  - {k}: {v}" for k, v in self.more)]


@dataclass(frozen=True)
class Document:
    """title, header pairs, prose by section, and bullets by section."""

    title: str
    head: tuple[tuple[str, str], ...] = ()
    prose: dict[str, str] = field(default_factory=dict)
    items: dict[str, tuple[Item, ...]] = field(default_factory=dict)

    def get(self, key: str, default: str = "") -> str:
        return dict(self.head).get(key, default)

    def put(self, section: str, item: Item) -> Document:
        """With item in place of the one of its name, or at the end."""
        old = self.items.get(section, ())
        new = tuple(item if x.name == item.name else x for x in old) if any(x.name == item.name for x in old) else (*old, item)
        return replace(self, items=self.items | {section: new})

    def find(self, section: str, name: str) -> Item:
        return next((x for x in self.items.get(section, ()) if x.name == name), Item(name))

    def header(self, **more: str | None) -> Document:
        kept = dict(self.head) | {k: v for k, v in more.items() if v is not None}
        return replace(self, head=tuple((k, v) for k, v in kept.items() if v))

    def render(self, order: tuple[str, ...] = ()) -> str:
        names = sorted({*self.prose, *self.items}, key=lambda s: order.index(s) if s in order else len(order))
        if not order:
            names = list(dict.fromkeys([*self.prose, *self.items]))
        out = [f"# {self.title}", "", f"format: {FORMAT}", *(f"{k}: {v}" for k, v in self.head)]
        for s in names:
            body = ([self.prose[s]] if self.prose.get(s) else []) + [line for x in self.items.get(s, ()) for line in x.lines()]
            out += ["", f"## {s}", "", *body] if body else []
        return "\n".join(out) + "\n"


def words(value: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in value.split(",") if x.strip())


def read(text: str, name: str) -> Document:
    """The document of a file's text; every refusal names the file and the line."""

    def refuse(why: str, at: int) -> MetadataError:
        return MetadataError(f"{name}:{at}: {why}")

    if "\r" in text or "\t" in text:
        raise refuse("lines end in LF alone and hold no tabs", 1)
    lines = text.split("\n")
    if not re.match(r"# \S", lines[0]):
        raise refuse("the first line is `# title`", 1)
    head: dict[str, str] = {}
    prose: dict[str, list[str]] = {}
    items: dict[str, list[Item]] = {}
    section = None
    for at, line in enumerate(lines[1:], 2):
        if line.startswith("## "):
            section = line[3:].strip()
            if section in prose:
                raise refuse(f"section {section!r} comes twice", at)
            prose[section], items[section] = [], []
        elif section is None:
            if not line.strip():
                continue
            pair = PAIR.match(line)
            if not pair or pair["key"] in head:
                raise refuse("a new `key: value` line is due here", at)
            head[pair["key"]] = (pair["value"] or "").strip()
        elif line.startswith("- "):
            b = BULLET.match(line)
            if not b:
                raise refuse("a bullet is `- name [flags]: text`", at)
            if any(x.name == b["name"] for x in items[section]):
                raise refuse(f"{b['name']!r} comes twice", at)
            items[section].append(Item(b["name"], (b["text"] or "").strip(), words(b["flags"] or "")))
        elif items[section] and line.startswith("  - "):
            pair, last = PAIR.match(line[4:]), items[section][-1]
            if not pair or last.get(pair["key"]):
                raise refuse("a new `  - key: value` line is due here", at)
            items[section][-1] = replace(last, more=(*last.more, (pair["key"], (pair["value"] or "").strip())))
        elif items[section] and line.startswith("  ") and line.strip():  # goes on with the text above
            last = items[section][-1]
            if last.more:
                key, value = last.more[-1]
                last = replace(last, more=(*last.more[:-1], (key, f"{value} {line.strip()}")))
            else:
                last = replace(last, text=f"{last.text} {line.strip()}".strip())
            items[section][-1] = last
        elif items[section] and line.strip():
            raise refuse("text behind a bullet is indented", at)
        else:
            prose[section].append(line)
    if head.pop("format", None) != FORMAT:
        raise refuse(f"`format: {FORMAT}` is missing", 2)
    return Document(lines[0][2:].strip(), tuple(head.items()), {s: "\n".join(x).strip("\n") for s, x in prose.items()}, {s: tuple(x) for s, x in items.items()})


def checked(doc: Document, name: str, keys: tuple[str, ...], sections: dict[str, tuple[str, ...]] | None, flags: dict[str, tuple[str, ...]] = {}) -> Document:  # noqa: B006
    """doc, if it has no other keys, sections, lines or flags than these."""
    if extra := [k for k, _ in doc.head if k not in keys]:
        raise MetadataError(f"{name}: unknown key {extra[0]!r}", keys)
    for s, found in doc.items.items():
        if sections is None:
            continue
        if s not in sections:
            raise MetadataError(f"{name}: unknown section {s!r}", tuple(sections))
        for x in found:
            if extra := [k for k, _ in x.more if k not in sections[s]]:
                raise MetadataError(f"{name}: {x.name}: unknown line {extra[0]!r}", sections[s])
            if extra := [f for f in x.flags if f not in flags.get(s, ())]:
                raise MetadataError(f"{name}: {x.name}: unknown flag {extra[0]!r}", flags.get(s, ()))
            groups = ({"searchable", "fulltext"}, {"sensitive"}, {"hidden"})
            if sum(bool(g & set(x.flags)) for g in groups) > 1:
                raise MetadataError(f"{name}: {x.name}: searchable or fulltext, sensitive and hidden exclude each other")
    return doc


def read_table(text: str, name: str) -> Document:
    lines = {"Description": (), "Columns": ("values", "synonyms", "source"), "Relationships": ("renames",), "Concepts": ("where",), "Measures": ("expr",)}
    doc = checked(read(text, name), name, ("purpose", "synonyms"), lines, {"Columns": FLAGS})
    if not doc.get("purpose"):
        raise MetadataError(f"{name}: purpose is missing")
    return doc


def read_project(text: str, name: str = "project.md") -> Document:
    doc = checked(read(text, name), name, ("description", "value_index", "value_index_max_distinct", "samples_per_column"), {})
    if doc.get("value_index", "off") not in ("on", "off"):
        raise MetadataError(f"{name}: value_index is on or off")
    for key, most in (("value_index_max_distinct", MOST_DISTINCT), ("samples_per_column", MOST_SAMPLES)):
        value = doc.get(key, "1")
        if not re.fullmatch("[0-9]{1,6}", value) or not 1 <= int(value) <= most:
            raise MetadataError(f"{name}: {key} is a number from 1 to {most}")
    return doc


def read_glossary(text: str, name: str = "glossary.md") -> Document:
    return checked(read(text, name), name, (), {"Terms": ("synonyms", "tables")})


def read_relationships(text: str, name: str = "relationships.md") -> tuple[Document, tuple[Relationship, ...]]:
    """Each section declares one relationship with the lines from, to, cardinality and text."""
    doc, out = checked(read(text, name), name, (), None), []
    for section, body in doc.prose.items():
        pairs = [PAIR.match(x) for x in body.split("\n") if x.strip()]
        found = {m["key"]: (m["value"] or "").strip() for m in pairs if m}
        ends = [END.match(found.get(k, "")) for k in ("from", "to")]
        if not all(pairs) or not all(ends) or found.get("cardinality") not in ("to_one", "to_many") or set(found) - {"from", "to", "cardinality", "text"}:
            raise MetadataError(f"{name}: {section}: from, to and cardinality (to_one, to_many) are due")
        a, b = (words(e["columns"]) for e in ends)
        if len(a) != len(b):
            raise MetadataError(f"{name}: {section}: from and to have the same number of columns")
        out.append(Relationship(section, ends[0]["table"], ends[1]["table"], tuple(zip(a, b, strict=True)), found["cardinality"] == "to_many", found.get("text", "")))
    return doc, tuple(out)


def parsed(item: Item, key: str, kind: type, where: str) -> Any:
    try:
        value = json.loads(item.get(key))
        return tuple(build(kind, x) for x in value) if kind is Filter else build(kind, value)
    except (ValueError, TypeError, EngineError) as e:
        raise MetadataError(f"{where}: {item.name}: {key}: {e}") from None


@dataclass(frozen=True)
class Metadata:
    tables: dict[str, Document] = field(default_factory=dict)
    project: Document = Document("project")
    declared: tuple[Relationship, ...] = ()
    glossary: Document = Document("glossary")

    def apply(self, spark: SparkSession, catalog: Catalog, **more: Any) -> Engine:
        """An engine over the catalog with all that the files say; what the catalog lacks is refused."""
        renamed: dict[tuple[str, str], str] = {}
        hidden, sensitive, fulltext, searchable, concepts, measures, notes, texts = set(), set(), set(), {}, {}, {}, {}, {}
        for name, doc in self.tables.items():
            t, where = catalog.table(name), f"tables/{name}.md"
            columns = {}
            for x in doc.items.get("Columns", ()):
                key = (t.name, t.column(x.name).name)
                hidden |= {key} if "hidden" in x.flags else set()
                sensitive |= {key} if "sensitive" in x.flags else set()
                fulltext |= {key} if "fulltext" in x.flags else set()
                if {"searchable", "fulltext"} & set(x.flags):
                    searchable[t.name] = (*searchable.get(t.name, ()), key[1])
                columns[key[1]] = ColumnNote(x.text, words(x.get("values")), words(x.get("synonyms")), "fulltext" in x.flags)
            for x in doc.items.get("Relationships", ()):
                old = catalog.relationship(t, x.get("renames") or x.name).name
                if old != x.name:
                    renamed[t.name, old] = x.name
                texts[t.name, x.name] = x.text
            for x in doc.items.get("Concepts", ()):
                concepts[t.name, x.name] = parsed(x, "where", Filter, where)
            for x in doc.items.get("Measures", ()):
                measures[t.name, x.name] = parsed(x, "expr", Measure, where)
            said = {s: {x.name: x.text for x in doc.items.get(s, ())} for s in ("Concepts", "Measures")}
            notes[t.name] = TableNote(doc.get("purpose"), " ".join(doc.prose.get("Description", "").split()), words(doc.get("synonyms")), columns, said["Concepts"], said["Measures"])
        for r in self.declared:
            for a, b in r.pairs:
                catalog.table(r.source).column(a), catalog.table(r.target).column(b)
        estimates = catalog.tables.estimates
        frames = {n: t.frame for n, t in catalog.tables.loaded.items()}
        full = Catalog(catalog.tables.frames | frames, catalog.keys, catalog.foreign_keys, renamed, self.declared, estimates, texts)
        planner = Planner(full, Policy(), more.get("limits", Engine.limits), lambda _: (), concepts, measures, Engine.now)
        for table, name in concepts:
            planner.plan(QuerySpec(table, concepts=(name,)))
        for table, name in measures:
            planner.plan(QuerySpec(table, measures=(Measure("measure", name),)))
        terms = tuple(Term(x.name, x.text, words(x.get("synonyms")), tuple(catalog.table(t).name for t in words(x.get("tables")))) for x in self.glossary.items.get("Terms", ()))
        cap = int(self.project.get("value_index_max_distinct", str(DISTINCT))) if self.project.get("value_index", "off") == "on" else 0
        more = {"index_cap": cap, "index_samples": int(self.project.get("samples_per_column", str(SAMPLES)))} | more
        return Engine(spark, full, policy=Policy(frozenset(hidden), frozenset(sensitive)), concepts=concepts, measures=measures, searchable=searchable, fulltext=frozenset(fulltext), notes=notes, glossary=terms, **more)

    def problems(self, spark: SparkSession, catalog: Catalog) -> list[str]:
        """What keeps the files from being applied to a catalog, file by file; nothing where all is well."""
        out = []
        parts = [replace(self, tables={n: d}, glossary=Document("glossary"), declared=()) for n, d in self.tables.items()]
        for part in (*parts, replace(self, tables={})):
            try:
                part.apply(spark, catalog)
            except EngineError as e:
                out.append(str(e))
        return out


class Store:
    """A folder of metadata files."""

    def __init__(self, root: str | Path):
        self.root = Path(root).resolve()

    def path(self, *parts: str) -> Path:
        """A file under the root; names that are no stem or lead elsewhere are refused."""
        if not STEM.match(parts[-1]):
            raise MetadataError(f"{parts[-1]!r} is no file name")
        found = self.root.joinpath(*parts[:-1], parts[-1] + ".md")
        if not found.resolve().is_relative_to(self.root):
            raise MetadataError(f"{parts[-1]!r} is outside the metadata folder")
        return found

    def text(self, *parts: str) -> str | None:
        p = self.path(*parts)
        return p.read_bytes().decode() if p.is_file() else None

    def load(self) -> Metadata:
        names = sorted(p.stem for p in (self.root / "tables").glob("*.md"))
        tables = {n: read_table(self.text("tables", n) or "", f"tables/{n}.md") for n in names}
        if wrong := [n for n, d in tables.items() if d.title != n]:
            raise MetadataError(f"tables/{wrong[0]}.md: the title is not the table's name")
        of = lambda name, reader, none: reader(text) if (text := self.text(name)) is not None else none
        return Metadata(tables, of("project", read_project, Document("project")), of("relationships", read_relationships, (None, ()))[1], of("glossary", read_glossary, Document("glossary")))


class Editor:
    """Edits files in a store: the edited set is applied to the catalog first, and an edit that fails leaves the files as they were."""

    def __init__(self, store: Store, build: Callable[[Metadata], Engine], today: Callable[[], dt.date] = dt.date.today):
        self.store, self.build, self.today = store, build, today
        self.metadata = store.load()
        self.engine = build(self.metadata)

    def save(self, parts: tuple[str, ...], before: Document | None, after: Document, order: tuple[str, ...] = ()) -> Engine:
        reader = read_table if parts[0] == "tables" else read_glossary
        path, text = self.store.path(*parts), after.render(order)
        disk = self.store.text(*parts)
        if (None if disk is None else reader(disk, path.name)) != before:
            raise MetadataConflictError(f"{path.name} has changed on disk; load it again")
        doc = reader(text, path.name)
        if doc.render(order) != text or any(getattr(doc, part) != getattr(after, part) for part in ("title", "head")) or {s: x for s, x in doc.items.items() if x} != {s: x for s, x in after.items.items() if x}:
            raise MetadataError(f"{path.name} would not be read as it was meant")
        new = replace(self.metadata, tables=self.metadata.tables | {parts[1]: doc}) if parts[0] == "tables" else replace(self.metadata, glossary=doc)
        engine = self.build(new)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_bytes(text.encode())
        part.replace(path)
        self.metadata, self.engine = new, engine
        return engine

    def edited(self, table: str, change: Callable[[Document], Document]) -> Engine:
        name = self.engine.catalog.table(table).name
        old = self.metadata.tables.get(name)
        return self.save(("tables", name), old, change(old or Document(name, (("purpose", f"Rows of {name}."),))), SECTIONS)

    def edit_table(self, table: str, purpose: str | None = None, description: str | None = None, synonyms: str | None = None) -> Engine:
        return self.edited(table, lambda d: replace(d.header(purpose=purpose, synonyms=synonyms), prose=d.prose | ({} if description is None else {"Description": description})))

    def edit_column(self, table: str, column: str, text: str | None = None, values: str | None = None, synonyms: str | None = None, searchable: bool | None = None) -> Engine:
        """The policy flags of a column stay as they are; a hidden column is not there."""

        def change(d: Document) -> Document:
            t = self.engine.catalog.table(table)
            name = t.column(column).name
            if (t.name, name) in self.engine.policy.hidden:
                raise UnknownColumnError(f"unknown column of {t.name}: {column!r}")
            x = d.find("Columns", name)
            flags = x.flags if searchable is None else (*(f for f in x.flags if f != "searchable"), *(["searchable"] if searchable else []))
            return d.put("Columns", replace(x, text=x.text if text is None else text, flags=flags).with_(values=values, synonyms=synonyms, source=f"agent, {self.today().isoformat()}"))

        return self.edited(table, change)

    def edit_relationship(self, table: str, name: str, text: str) -> Engine:
        self.engine.catalog.relationship(self.engine.catalog.table(table), name)
        return self.edited(table, lambda d: d.put("Relationships", replace(d.find("Relationships", name), text=text)))

    def edit_concept(self, table: str, name: str, text: str, where: list[dict]) -> Engine:
        return self.edited(table, lambda d: d.put("Concepts", replace(d.find("Concepts", name), text=text).with_(where=json.dumps(where, ensure_ascii=False))))

    def edit_glossary(self, term: str, definition: str, synonyms: str | None = None, tables: str | None = None) -> Engine:
        old = self.metadata.glossary
        new = old.put("Terms", replace(old.find("Terms", term), text=definition).with_(synonyms=synonyms, tables=tables))
        return self.save(("glossary",), old if self.store.text("glossary") is not None else None, new)
