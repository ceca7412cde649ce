"""Descriptions of the tools as JSON Schema, in the shapes that callers of language models use, and the instructions beside them."""

from __future__ import annotations

from typing import Any

from minnow.editing import FULL, Workbench
from minnow.engine import TIERS, Engine
from minnow.operators.search import DEFAULT
from minnow.plans.spec import DIRECTIONS, FORMATS, FUNCTIONS, OPERATORS

ALL_TIERS = (*TIERS, FULL)
FORMAT = {"type": "string", "enum": list(FORMATS)}
TEXT = {"type": "string"}
NUMBER = {"type": "integer", "minimum": 1}


def described(schema: dict, text: str) -> dict:
    return schema | {"description": text}


def listed(items: dict, text: str) -> dict:
    return {"type": "array", "items": items, "description": text}


def record(required: tuple[str, ...], **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}


SCALAR = {"type": ["string", "number", "boolean", "null"]}
TABLE = described(TEXT, "Name of a table.")
PATH = described(TEXT, "A column, or relationship names and a column joined by dots.")
FILTER = record(("column", "op"), column=PATH, op={"type": "string", "enum": list(OPERATORS)}, value={"description": "A scalar; a list for in, not_in and between; nothing for is_null and not_null.", "anyOf": [SCALAR, {"type": "array", "items": SCALAR}]})
MEASURE = record(("fn",), fn={"type": "string", "enum": list(FUNCTIONS)}, column=described(TEXT, "A path; for fn measure the name of a measure."), alias=described(TEXT, "Name of the output."))
ORDER = record(("by",), by=described(TEXT, "An output or a column."), direction={"type": "string", "enum": list(DIRECTIONS)})

#: name: (description, schema), for each tier the tools that it adds.
ADDED: dict[str, dict[str, tuple[str, dict]]] = {
    "minimal": {
        "get_context": ("Tables, columns, values and terms that a question is about. Call this first.", record(("question",), question=described(TEXT, "The question, 2000 characters at most."), budget_tokens=described(NUMBER, "Size of the answer."), format=FORMAT)),
        "query": ("Rows of a table, or groups and measures, with joins along relationships.", record(
            ("table",), table=TABLE, columns=listed(PATH, "Columns to return, without group_by and measures."), filters=listed(FILTER, "All must hold."), concepts=listed(TEXT, "Named conditions."), group_by=listed(PATH, "Columns to group by."),
            measures=listed(MEASURE, "Aggregates."), order=listed(ORDER, "Order of the rows."), limit=described(NUMBER, "Rows to return."), format=FORMAT,
        )),
    },
    "standard": {
        "describe_table": ("Columns, relationships, concepts and measures of a table.", record(("table",), table=TABLE, format=FORMAT)),
        "list_tables": ("All tables.", record((), format=FORMAT)),
        "search_rows": ("Rows whose text is like a term, misspelt words included.", record(
            ("table", "term"), table=TABLE, term=described(TEXT, "Words to look for."), columns=listed(TEXT, "Searchable columns."), match={"type": "string", "enum": ["all", "any"], "description": "Words that must be found."},
            strategies=listed({"type": "string"}, f"Ways to compare; {', '.join(DEFAULT)} unless given."), limit=described(NUMBER, "Rows to return."), format=FORMAT,
        )),
    },
    FULL: {
        "edit_table": ("Describe a table.", record(("table",), table=TABLE, purpose=described(TEXT, "What its rows are."), description=described(TEXT, "Prose."), synonyms=described(TEXT, "Other names, with commas."))),
        "edit_column": ("Describe a column.", record(("table", "column"), table=TABLE, column=described(TEXT, "Name of a column."), text=described(TEXT, "What it holds."), values=described(TEXT, "Known values, with commas."), synonyms=described(TEXT, "Other names, with commas."), searchable={"type": "boolean", "description": "Whether search_rows looks there."})),
        "edit_relationship": ("Describe a relationship.", record(("table", "name", "text"), table=TABLE, name=described(TEXT, "Its name."), text=described(TEXT, "What it means."))),
        "edit_concept": ("Define a named condition.", record(("table", "name", "text", "where"), table=TABLE, name=described(TEXT, "Its name."), text=described(TEXT, "What it means."), where=listed(FILTER, "All must hold."))),
        "edit_glossary": ("Define a term.", record(("term", "definition"), term=TEXT, definition=TEXT, synonyms=described(TEXT, "Other names, with commas."), tables=described(TEXT, "Tables it concerns, with commas."))),
    },
}


def specs(tier: str = "standard", engine: Engine | Workbench | None = None) -> dict[str, tuple[str, dict]]:
    """Tools of a tier and of those below it, and with an engine those that it has itself."""
    found = {name: spec for t in ALL_TIERS[: ALL_TIERS.index(tier) + 1] for name, spec in ADDED[t].items()}
    if engine is None:
        return found
    own = {t.name: (t.description, t.schema) for t in of(engine).custom}
    return {name: (found | own)[name] for name in engine.tools(tier)}


def of(engine: Engine | Workbench) -> Engine:
    return engine.editor.engine if isinstance(engine, Workbench) else engine


def plain(tier: str = "standard", engine: Engine | Workbench | None = None) -> list[dict]:
    return [{"name": n, "description": text, "input_schema": schema} for n, (text, schema) in specs(tier, engine).items()]


def strict(schema: Any) -> Any:
    """The schema with all properties required; those that were not may be null instead."""
    if isinstance(schema, list):
        return [strict(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict(v) for k, v in schema.items() if k != "properties"}
    if "properties" in schema:
        needed = schema.get("required", ())
        out["properties"] = {k: strict(v) if k in needed else {"anyOf": [strict(v), {"type": "null"}]} for k, v in schema["properties"].items()}
        out["required"] = list(schema["properties"])
    return out


def function_calling(tier: str = "standard", engine: Engine | Workbench | None = None) -> list[dict]:
    return [{"type": "function", "function": {"name": n, "description": text, "strict": True, "parameters": strict(schema)}} for n, (text, schema) in specs(tier, engine).items()]


def protocol(tier: str = "standard", engine: Engine | Workbench | None = None) -> list[dict]:
    """As the model context protocol lists them; all but the edits and tools of the host that say so only read."""
    changing = {*ADDED[FULL], *(t.name for t in (of(engine).custom if engine else ()) if t.mutating)}
    return [{"name": n, "description": text, "inputSchema": schema, "annotations": {"readOnlyHint": n not in changing, "destructiveHint": False, "openWorldHint": False}} for n, (text, schema) in specs(tier, engine).items()]


def without_nulls(value: Any) -> Any:
    """Arguments as given by a strict caller, who writes null for what is left out."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(x) for x in value] if isinstance(value, list) else value


def call(engine: Engine | Workbench, name: str, arguments: dict[str, Any], tier: str = "standard") -> dict:
    return engine.dispatch(name, without_nulls(arguments), tier)


def instructions(engine: Engine | Workbench, tier: str = "standard") -> str:
    """How to use the tools; no table of the data is named, so that it stays small and says nothing of hidden ones."""
    tools, lim = specs(tier, engine), engine.limits
    lines = [
        f"{len(engine.catalog.tables)} tables can be read with {', '.join(tools)}. {'Only descriptions' if tier == FULL else 'Nothing'} can be changed.",
        "Start with get_context and the user's question; use the names and values it gives as they are.",
        f"Join by dotted paths such as relationship.column, {lim.max_join_depth} relationships deep at most. Prefer named concepts and measures.",
        f"Answers hold {lim.max_rows} rows unless limit says otherwise, {lim.hard_max_rows} at most; truncated means that there are more.",
        "An error carries suggestions; correct the request by them.",
    ]
    if "search_rows" in tools:
        lines.insert(3, "Where a name may be misspelt, find its row with search_rows before filtering.")
    return "\n".join(lines)
