"""Tools that edit the metadata files, beside those that read."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from minnow.catalog import Catalog
from minnow.engine import answered, as_text
from minnow.errors import QuerySpecError, ReadOnlyError
from minnow.metadata import Editor
from minnow.plans.planner import Limits

FULL = "full"


def safe(field: str, value: Any) -> None:
    """An edit may not bring lines, headings or flags of its own into a file."""
    name, prose = field in ("name", "term"), field == "description"
    if not isinstance(value, str):
        raise QuerySpecError(f"{field} is a text")
    if name and not re.fullmatch(r"[^\W_][\w .'-]*", value):
        raise QuerySpecError(f"{field} has letters, digits, spaces and . ' - _ only")
    lines = value.split("\n") if prose else [value]
    if any(not x.isprintable() for x in lines) or prose and any(x.lstrip().startswith(("#", "-")) for x in lines):
        raise QuerySpecError(f"{field} is one line" if not prose else "description is prose without headings and bullets")


class Workbench:
    """An engine and an editor of its files behind one dispatch; edits are in the full tier only."""

    def __init__(self, editor: Editor):
        self.editor = editor

    @property
    def catalog(self) -> Catalog:
        return self.editor.engine.catalog

    @property
    def limits(self) -> Limits:
        return self.editor.engine.limits

    def edit_table(self, table: str, purpose: str | None = None, description: str | None = None, synonyms: str | None = None) -> dict:
        return self.done(self.editor.edit_table, table, purpose=purpose, description=description, synonyms=synonyms)

    def edit_column(self, table: str, column: str, text: str | None = None, values: str | None = None, synonyms: str | None = None, searchable: bool | None = None) -> dict:
        return self.done(lambda t, column, **texts: self.editor.edit_column(t, column, searchable=searchable, **texts), table, column=column, text=text, values=values, synonyms=synonyms)

    def edit_relationship(self, table: str, name: str, text: str) -> dict:
        return self.done(self.editor.edit_relationship, table, name=name, text=text)

    def edit_concept(self, table: str, name: str, text: str, where: list[dict]) -> dict:
        return self.done(lambda t, name, text: self.editor.edit_concept(t, name, text, where), table, name=name, text=text)

    def edit_glossary(self, term: str, definition: str, synonyms: str | None = None, tables: str | None = None) -> dict:
        return self.done(lambda _, **texts: self.editor.edit_glossary(**texts), None, term=term, definition=definition, synonyms=synonyms, tables=tables)

    def done(self, edit: Callable[..., Any], table: str | None, **texts: str | None) -> dict:
        if not self.editor.engine.switches.allow_metadata_writes:
            raise ReadOnlyError("descriptions cannot be edited here")
        for field, value in texts.items():
            if value is not None:
                safe(field, value)
        edit(table, **texts)
        return {"edited": texts["term"] if table is None else self.catalog.table(table).name}

    def tools(self, tier: str = FULL) -> dict[str, Callable[..., dict]]:
        if tier != FULL or not self.editor.engine.switches.allow_metadata_writes:
            return self.editor.engine.tools(tier)
        edits = (self.edit_table, self.edit_column, self.edit_relationship, self.edit_concept, self.edit_glossary)
        return self.editor.engine.tools(FULL) | {f.__name__: f for f in edits}

    def dispatch(self, name: str, arguments: dict[str, Any], tier: str = FULL) -> dict:
        return answered(lambda: self.catalog.fingerprint, self.tools(tier), name, arguments)

    def dispatch_text(self, name: str, arguments: dict[str, Any], tier: str = FULL) -> str:
        return as_text(self.dispatch(name, arguments, tier), arguments)
