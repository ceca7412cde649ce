import inspect
import json

import pytest

from minnow import server, tools
from minnow.catalog import Catalog
from minnow.editing import FULL, Workbench
from minnow.engine import Engine, Switches
from minnow.errors import ReadOnlyError
from minnow.metadata import Editor, Store


@pytest.fixture()
def bench(spark, tmp_path):
    catalog = Catalog({"fish": spark.createDataFrame([(1, "carp"), (2, "pike")], "id long, name string")}, {"fish": ("id",)})
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables/fish.md").write_text("# fish\n\nformat: 1\npurpose: Kinds.\n\n## Columns\n\n- id [hidden]: Key.\n")
    return Workbench(Editor(Store(tmp_path), lambda m: m.apply(spark, catalog, switches=Switches(allow_metadata_writes=True))))


def test_edits_are_tools_of_the_full_tier(bench):
    assert set(bench.tools()) == set(tools.specs(FULL)) and set(bench.tools("standard")) == set(tools.specs("standard"))
    for name, (_, schema) in tools.ADDED[FULL].items():
        parameters = inspect.signature(bench.tools()[name]).parameters
        assert set(schema["properties"]) == set(parameters)
        assert schema["required"] == [k for k, p in parameters.items() if p.default is p.empty]
    assert {x["name"] for x in tools.protocol(FULL) if not x["annotations"]["readOnlyHint"]} == set(tools.ADDED[FULL])
    assert bench.dispatch("edit_table", {"table": "fish", "purpose": "x"}, "standard")["error"]["type"] == "UnknownToolError"


def test_an_edit_is_seen_at_once(bench):
    asked = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "edit_concept", "arguments": {"table": "fish", "name": "long", "text": "Long ones.", "where": [{"column": "name", "op": "eq", "value": "pike"}]}}}
    out = json.loads(server.answer(bench, json.dumps(asked), FULL))["result"]
    assert not out["isError"] and out["structuredContent"]["edited"] == "fish"
    assert bench.dispatch("query", {"table": "fish", "concepts": ["long"], "columns": ["name"]})["rows"] == [["pike"]]
    assert bench.dispatch("edit_glossary", {"term": "Water", "definition": "Wet.", "tables": "fish"})["edited"] == "Water"
    assert bench.dispatch("edit_column", {"table": "fish", "column": "name", "searchable": True})["edited"] == "fish"
    assert bench.dispatch("search_rows", {"table": "fish", "term": "carp"})["rows"] == [["carp"]]


@pytest.mark.parametrize(("tool", "arguments"), [
    ("edit_table", {"table": "fish", "purpose": "x\n\n## Columns\n\n- id: Key."}), ("edit_table", {"table": "fish", "description": "x\n## Columns"}), ("edit_column", {"table": "fish", "column": "id", "text": "x"}),
    ("edit_column", {"table": "fish", "column": "name", "searchable": "yes"}), ("edit_concept", {"table": "fish", "name": "a [b]", "text": "x", "where": []}), ("edit_glossary", {"term": "a: b", "definition": "x"}),
    ("edit_table", {"table": "fish", "purpose": 5}), ("edit_table", {"table": "bird", "purpose": "x"}), ("edit_relationship", {"table": "fish", "name": "none", "text": "x"}),
])
def test_refused_edits_leave_the_files(bench, tool, arguments):
    before = bench.editor.store.text("tables", "fish")
    assert "error" in bench.dispatch(tool, arguments)
    assert bench.editor.store.text("tables", "fish") == before and bench.editor.store.text("glossary") is None


def test_the_audit_hook_learns_no_value(spark):
    seen = []
    e = Engine(spark, Catalog({"fish": spark.createDataFrame([(1, "carp"), (2, "pike")], "id long, name string")}, {"fish": ("id",)}), searchable={"fish": ("name",)}, audit=seen.append)
    e.query(table="fish", columns=["id"], filters=[{"column": "name", "op": "in", "value": ["pike", "eel"]}])
    e.search_rows("fish", "carp")
    assert [(s.command, s.values, s.rows) for s in seen] == [("query", 2, 1), ("search_rows", 1, 1)]
    assert json.loads(seen[0].shape)["filters"] == [["name", "in"]] and all(s.seconds > 0 for s in seen)
    assert not any(word in str(s) for s in seen for word in ("pike", "eel", "carp"))


def test_edits_are_refused_unless_allowed(spark, bench):
    bench.editor.engine.switches = Switches()
    assert bench.dispatch("edit_table", {"table": "fish", "purpose": "x"})["error"]["type"] == "UnknownToolError" and "edit_table" not in tools.specs(FULL, bench)
    with pytest.raises(ReadOnlyError):
        bench.edit_table("fish", purpose="x")
