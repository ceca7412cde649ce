"""Cards of tables, their ranking for a question, and the plain text of answers.

All of it is about metadata, which is small: nothing here runs a Spark job.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from minnow.catalog import Catalog, Table
from minnow.errors import EmbeddingError
from minnow.functions.text import CAMEL, STOPWORDS
from minnow.notes import ColumnNote, TableNote, Term
from minnow.operators.retrieval import K1, RRF_K, B
from minnow.plans.planner import Policy

# Weights of a table's texts, weights of the rankings that are fused, and how many values a text shows.
FIELDS = {"name": 3.0, "synonyms": 2.5, "purpose": 1.5, "columns": 1.0, "description": 0.7, "glossary": 1.0, "concepts": 1.0, "relationships": 0.5}
SOURCES = {"words": 1.0, "values": 1.5, "vectors": 1.0}
MOST_VALUES = 8
CHARS_A_TOKEN = 4


def tokens(text: str) -> list[str]:
    """As functions.text.tokens, for text of the driver."""
    found = [t for t in re.split("[^a-z0-9]+", re.sub(CAMEL, " ", text).lower()) if len(t) >= 2 and t not in STOPWORDS]
    endings = (("ies", 5, 3, "y"), ("sses", 4, 2, ""), ("ss", 2, 0, ""), ("s", 4, 1, ""))

    def singular(t: str) -> str:
        end = next((e for e in endings if t.endswith(e[0]) and len(t) >= e[1]), None)
        return t[: len(t) - end[2]] + end[3] if end else t

    return [singular(t) for t in found]


@dataclass
class Vectors:
    """Unit vectors of texts by id, from a callback; they are made again only when the texts change."""

    embed: Callable[[list[str]], Sequence[Sequence[float]]]
    texts: dict[str, str] = field(default_factory=dict)
    units: dict[str, list[float]] = field(default_factory=dict)

    def of(self, texts: list[str]) -> list[list[float]]:
        found = [list(map(float, v)) for v in self.embed(texts)]
        if len(found) != len(texts):
            raise EmbeddingError(f"{len(found)} vectors came for {len(texts)} texts")
        if len({len(v) for v in found}) > 1 or any(not math.isfinite(x) for v in found for x in v):
            raise EmbeddingError("vectors have one length and finite numbers")
        return [[x / n for x in v] if (n := math.sqrt(sum(x * x for x in v))) else v for v in found]

    def nearest(self, question: str, texts: dict[str, str]) -> list[str]:
        """Ids by falling cosine with the question, those at 0 or below left out; ties by id."""
        if texts != self.texts:
            self.units = dict(zip(texts, self.of(list(texts.values())), strict=True)) if texts else {}
            self.texts = dict(texts)
        (asked,) = self.of([question])
        if any(len(v) != len(asked) for v in self.units.values()):
            raise EmbeddingError("the question's vector has another length than those of the tables")
        score = {k: sum(a * b for a, b in zip(v, asked, strict=True)) for k, v in self.units.items()}
        return sorted((k for k, x in score.items() if x > 0), key=lambda k: (-score[k], k))


def by_words(question: list[str], texts: Mapping[str, Mapping[str, str]]) -> list[str]:
    """Ids of texts (field by field) by falling BM25 score above 0; ties by id."""
    counts = {}
    for k, parts in texts.items():
        counts[k] = sum((Counter({t: n * FIELDS[f] for t, n in Counter(tokens(x)).items()}) for f, x in parts.items()), Counter())
    size = {k: sum(c.values()) for k, c in counts.items()}
    mean = sum(size.values()) / max(len(size), 1) or 1.0

    def score(k: str) -> float:
        total = 0.0
        for t in question:
            df = sum(t in c for c in counts.values())
            tf = counts[k].get(t, 0.0)
            total += math.log(1 + (len(counts) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[k] / mean))
        return total

    found = {k: x for k in counts if (x := score(k)) > 0}
    return sorted(found, key=lambda k: (-found[k], k))


def fused(rankings: dict[str, list[str]]) -> list[str]:
    """Ids by the sum of weight / (60 + rank) over the rankings; ties by id."""
    total: defaultdict[str, float] = defaultdict(float)
    for source, ids in rankings.items():
        for rank, k in enumerate(ids, 1):
            total[k] += SOURCES[source] / (RRF_K + rank)
    return sorted(total, key=lambda k: (-total[k], k))


def terms_of(question: list[str], glossary: Iterable[Term]) -> list[Term]:
    """Terms that share a token, of their name or a synonym, with the question."""
    asked = set(question)
    return [t for t in glossary if asked & set(tokens(" ".join((t.name, *t.synonyms))))]


def spare(record: dict[str, Any]) -> dict[str, Any]:
    """Without what says nothing."""
    return {k: v for k, v in record.items() if v not in (None, "", [], (), False)}


@dataclass(frozen=True)
class Cards:
    """What callers may know of tables: hidden columns are in none of it."""

    catalog: Catalog
    policy: Policy
    notes: Mapping[str, TableNote]
    glossary: tuple[Term, ...]
    concepts: Mapping[tuple[str, str], Any]
    measures: Mapping[tuple[str, str], Any]
    searchable: Mapping[str, tuple[str, ...]]
    estimates: bool = True

    def note(self, t: Table) -> TableNote:
        return self.notes.get(t.name, TableNote())

    def named(self, t: Table, known: Mapping[tuple[str, str], Any], texts: Mapping[str, str]) -> list[dict]:
        return [spare({"name": n, "text": texts.get(n)}) for table, n in sorted(known) if table == t.name]

    def summary(self, t: Table) -> dict:
        rows = t.row_estimate if self.estimates else None
        return {"table": t.name, "purpose": self.note(t).purpose, "columns": len(self.policy.columns(t))} | ({} if rows is None else {"rows": rows})

    def columns(self, t: Table, full: bool) -> list[dict]:
        key, note = self.policy.primary_key(t), self.note(t)
        links = {k.columns[0]: f"{k.target}.{k.target_columns[0]}" for k in self.policy.foreign_keys(self.catalog, t) if len(k.columns) == 1}
        out = []
        for c in self.policy.columns(t):
            said, closed = note.columns.get(c.name, ColumnNote()), (t.name, c.name) in self.policy.sensitive
            short = {"name": c.name, "kind": str(c.kind), "key": c.name in key, "references": links.get(c.name), "sensitive": closed}
            more = {
                "type": c.data_type, "required": not c.nullable, "text": said.text, "values": [] if closed else list(said.values), "synonyms": list(said.synonyms),
                "searchable": c.name in self.searchable.get(t.name, ()), "fulltext": said.fulltext,
            }
            out.append(spare(short | (more if full else {"text": said.text, "values": more["values"][:MOST_VALUES]})))
        return out

    def card(self, t: Table, full: bool = True) -> dict:
        """All that is known of a table; the short form leaves out types, flags, prose and other names."""
        note = self.note(t)
        related = [spare({"name": r.name, "table": r.target, "many": r.to_many, "text": r.text if full else None}) for r in self.catalog.related(t.name)]
        said = {"description": note.description, "synonyms": list(note.synonyms)} if full else {}
        parts = {"relationships": related, "concepts": self.named(t, self.concepts, note.concepts), "measures": self.named(t, self.measures, note.measures)}
        return self.summary(t) | spare(said) | {"columns": self.columns(t, full)} | parts

    def texts(self, t: Table) -> dict[str, str]:
        """The fields that a table is found by."""
        note, seen = self.note(t), [c.name for c in self.policy.columns(t)]
        about = [x for name in seen if (x := note.columns.get(name))]
        named = lambda known, texts: " ".join(f"{n} {texts.get(n, '')}" for table, n in sorted(known) if table == t.name)
        return {
            "name": t.name,
            "synonyms": " ".join((*note.synonyms, *(s for x in about for s in x.synonyms))),
            "purpose": note.purpose,
            "columns": " ".join(seen),
            "description": " ".join((note.description, *(x.text for x in about))),
            "glossary": " ".join(" ".join((x.name, *x.synonyms, x.text)) for x in self.glossary if t.name in x.tables),
            "concepts": f"{named(self.concepts, note.concepts)} {named(self.measures, note.measures)}",
            "relationships": " ".join(f"{r.name} {r.text}" for r in self.catalog.related(t.name)),
        }

    def pack(self, order: list[str], budget: int) -> tuple[list[dict], list[dict], int]:
        """Short cards of tables in order and of those they lead to, or one line each, as far as the budget of tokens goes."""
        near = [r.target for name in order for r in self.catalog.related(name)]
        left, cards, lines = budget, [], []
        for name in dict.fromkeys(order + near):
            t = self.catalog.tables[name]
            forms = [(cards, self.card(t, full=False))] if name in order else []
            for place, form in (*forms, (lines, spare(self.summary(t)))):
                cost = len(json.dumps(form, ensure_ascii=False)) // CHARS_A_TOKEN
                if cost <= left:
                    place.append(form)
                    left -= cost
                    break
        return cards, lines, budget - left


# Plain text of answers: a line for each thing, without the punctuation of JSON.


def column_text(c: dict) -> str:
    marks = [x for x, on in (("key", c.get("key")), (f"-> {c.get('references')}", c.get("references")), ("sensitive", c.get("sensitive")), ("searchable", c.get("searchable"))) if on]
    values = c.get("values", [])
    shown = f" ({', '.join(values[:MOST_VALUES])}{', ...' if len(values) > MOST_VALUES else ''})" if values else ""
    said = f": {c['text']}" if c.get("text") else ""
    return f"- {c['name']} {c['kind']}{f' [{', '.join(marks)}]' if marks else ''}{said}{shown}"


def summary_text(x: dict) -> str:
    return f"{x['table']}{f': {x["purpose"]}' if x.get('purpose') else ''}{f' ({x["rows"]} rows)' if 'rows' in x else ''}"


def card_text(x: dict) -> str:
    joins = [f"{r['name']} -> {r['table']}{' (many)' if r.get('many') else ''}" if r["name"] != r["table"] or r.get("many") else r["name"] for r in x["relationships"]]
    names = lambda key: ", ".join(e["name"] for e in x[key])
    lines = [summary_text(x), x.get("description", ""), *map(column_text, x["columns"])]
    lines += [f"{title}: {text}" for title, text in (("joins", ", ".join(joins)), ("concepts", names("concepts")), ("measures", names("measures"))) if text]
    return "\n".join(line for line in lines if line)


def value_text(v: Any) -> str:
    return "" if v is None else str(v).replace("\n", " ").replace("|", "/") if not isinstance(v, bool) else str(v).lower()


def rows_text(x: dict) -> str:
    body = ["|".join(x["columns"]), *("|".join(map(value_text, r)) for r in x["rows"])]
    notes = (["there are more rows"] if x["truncated"] else []) + x["notes"]
    return "\n".join(body + [f"note: {n}" for n in notes])


def context_text(x: dict) -> str:
    parts = [card_text(c) for c in x["tables"]]
    parts += ["also: " + "; ".join(map(summary_text, x["also"]))] if x["also"] else []
    parts += ["values: " + "; ".join(f"{v['table']}.{v['column']} = {v['value']}" for v in x["values"])] if x["values"] else []
    parts += [f"{name}: {text}" for name, text in x["glossary"].items()]
    return "\n\n".join(parts)


def plain(answer: dict) -> str:
    """An answer of any tool as text."""
    if "error" in answer:
        e = answer["error"]
        return f"{e['type']}: {e['message']}" + (f" (perhaps {', '.join(e['suggestions'])})" if e["suggestions"] else "")
    if "rows" in answer and "truncated" in answer:
        return rows_text(answer)
    if "used_tokens" in answer:
        return context_text(answer)
    if "relationships" in answer:
        return card_text(answer)
    if "tables" in answer:
        return "\n".join(map(summary_text, answer["tables"]))
    return json.dumps(answer, ensure_ascii=False)
