"""What people have written about tables, columns and terms: it adds to the catalog and changes no result."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ColumnNote:
    text: str = ""
    values: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()
    fulltext: bool = False


@dataclass(frozen=True)
class TableNote:
    purpose: str = ""
    description: str = ""
    synonyms: tuple[str, ...] = ()
    columns: dict[str, ColumnNote] = field(default_factory=dict)
    concepts: dict[str, str] = field(default_factory=dict)
    measures: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Term:
    """An entry of the glossary."""

    name: str
    text: str = ""
    synonyms: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
