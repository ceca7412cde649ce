import datetime as dt

import pytest

from minnow.catalog import Catalog, ForeignKey
from minnow.errors import EngineError, MetadataError, SensitiveColumnError, UnknownNameError
from minnow.metadata import SECTIONS, Editor, Store, read_project, read_relationships, read_table

SALES = """# sales

format: 1
purpose: What was sold.
synonyms: deals

## Description

One row a sale.

## Columns

- state [searchable]: How far it is.
  - values: open, done
- memo [hidden]: Notes.
- amount [sensitive]: Price.

## Relationships

- buyer: Who bought.
  - renames: buyers

## Concepts

- pending: Not done yet.
  - where: [{"column": "state", "op": "eq", "value": "open"}]

## Measures

- n_sales: Number of sales.
  - expr: {"fn": "count"}
"""


@pytest.fixture()
def catalog(spark):
    frames = {
        "buyers": spark.createDataFrame([(1, "Ann"), (2, "Bob")], "id long, name string"),
        "sales": spark.createDataFrame([(1, 1, "open", "m", 5.0), (2, 2, "done", "m", 6.0), (3, 1, "open", "m", 7.0)], "id long, buyer_id long, state string, memo string, amount double"),
    }
    return Catalog(frames, {"buyers": ("id",), "sales": ("id",)}, (ForeignKey("sales", ("buyer_id",), "buyers"),))


@pytest.fixture()
def store(tmp_path):
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables/sales.md").write_text(SALES)
    (tmp_path / "glossary.md").write_text("# glossary\n\nformat: 1\n\n## Terms\n\n- Deal: A sale.\n  - tables: sales\n")
    return Store(tmp_path)


def test_canonical_text_is_written_as_read():
    assert read_table(SALES, "sales.md").render(SECTIONS) == SALES
    wrapped = SALES.replace("How far it is.", "How far\n  it is.")
    assert read_table(wrapped, "sales.md").render(SECTIONS) == SALES


@pytest.mark.parametrize(("old", "new"), [
    ("# sales", "sales"), ("format: 1", "format: 2"), ("purpose: What was sold.\n", ""), ("synonyms", "aliases"), ("## Columns", "## Fields"),
    ("[hidden]", "[hidden, sensitive]"), ("[searchable]", "[secret]"), ("- memo", "- state"), ("  - values", "  - vals"), ("One row", "One\trow"),
])
def test_bad_tables_are_refused(old, new):
    with pytest.raises(MetadataError):
        read_table(SALES.replace(old, new, 1), "sales.md")


def test_project_and_relationships():
    assert read_project("# project\n\nformat: 1\nvalue_index: off\nsamples_per_column: 10\n").get("value_index") == "off"
    for line in ("value_index: maybe", "samples_per_column: 11", "value_index_max_distinct: 0", "colour: red"):
        with pytest.raises(MetadataError):
            read_project(f"# project\n\nformat: 1\n{line}\n")
    text = "# relationships\n\nformat: 1\n\n## twin\n\nfrom: sales (id, state)\nto: sales (id, memo)\ncardinality: to_many\n"
    (r,) = read_relationships(text)[1]
    assert (r.name, r.pairs, r.to_many) == ("twin", (("id", "id"), ("state", "memo")), True)
    with pytest.raises(MetadataError):
        read_relationships(text.replace("(id, memo)", "(id)"))


def test_engine_follows_the_files(spark, catalog, store):
    e = store.load().apply(spark, catalog)
    assert e.query(table="sales", concepts=["pending"], columns=["id", "buyer.name"])["rows"] == [[1, "Ann"], [3, "Ann"]]
    assert e.query(table="sales", measures=[{"fn": "measure", "column": "n_sales"}])["rows"] == [[3]]
    with pytest.raises(UnknownNameError):
        e.query(table="sales", columns=["memo"])
    with pytest.raises(SensitiveColumnError):
        e.query(table="sales", columns=["amount"])
    assert e.searchable == {"sales": ("state",)} and [(t.name, t.text, t.tables) for t in e.glossary] == [("Deal", "A sale.", ("sales",))]


@pytest.mark.parametrize(("old", "new"), [("- state [", "- stage ["), ("renames: buyers", "renames: nobody"), ('"column": "state"', '"column": "stage"'), ('"fn": "count"', '"fn": "mode"'), ('[{"column"', '{"column"')])
def test_files_that_do_not_fit_the_catalog(spark, catalog, store, old, new):
    (store.root / "tables/sales.md").write_text(SALES.replace(old, new))
    with pytest.raises(EngineError):
        store.load().apply(spark, catalog)


def test_paths_stay_inside(store):
    for name in ("../x", "a/b", "", ".hidden"):
        with pytest.raises(MetadataError):
            store.path("tables", name)


def test_edits(spark, catalog, store):
    editor = Editor(store, lambda m: m.apply(spark, catalog), lambda: dt.date(2026, 9, 13))
    editor.edit_table("buyers", purpose="People.")
    editor.edit_column("sales", "state", text="Stage.", searchable=False)
    editor.edit_relationship("sales", "buyer", "The person.")
    editor.edit_concept("sales", "big", "Over 6.", [{"column": "id", "op": "gt", "value": 2}])
    editor.edit_glossary("Buyer", "Who pays.", tables="buyers")
    text = store.text("tables", "sales")
    assert "- state: Stage.\n  - values: open, done\n  - source: agent, 2026-09-13\n" in text and "- buyer: The person.\n  - renames: buyers\n" in text
    assert editor.engine.query(table="sales", concepts=["big"], columns=["id"])["rows"] == [[3]]
    assert Store(store.root).load() == editor.metadata
    with pytest.raises(EngineError):
        editor.edit_concept("sales", "bad", "x", [{"column": "nope", "op": "is_null"}])
    with pytest.raises(UnknownNameError):
        editor.edit_column("sales", "memo", text="x")
    assert store.text("tables", "sales") == text
    (store.root / "tables/sales.md").write_text(text.replace("Stage.", "Other."))
    with pytest.raises(MetadataError):
        editor.edit_table("sales", purpose="New.")


def test_project_settings_reach_the_value_index(spark, catalog, store):
    (store.root / "project.md").write_text("# project\n\nformat: 1\nvalue_index: on\nvalue_index_max_distinct: 1\nsamples_per_column: 1\n")
    rows = store.load().apply(spark, catalog).value_index().collect()
    assert {(r["table"], r["column"], r["value"], r["complete"]) for r in rows} == {("buyers", "name", "Ann", False), ("sales", "state", "open", False)}
    (store.root / "project.md").write_text("# project\n\nformat: 1\nvalue_index: off\n")
    e = store.load().apply(spark, catalog)
    assert e.value_index().count() == 0 and e.get_context("which sales are open")["values"] == []


def test_what_is_written_is_seen(spark, catalog, store):
    e = store.load().apply(spark, catalog)
    card = e.describe_table("sales")
    assert card["description"] == "One row a sale." and card["synonyms"] == ["deals"] and card["measures"] == [{"name": "n_sales", "text": "Number of sales."}]
    assert card["columns"][2] == {"name": "state", "kind": "text", "type": "string", "text": "How far it is.", "values": ["open", "done"], "searchable": True}
    assert [r["text"] for r in card["relationships"]] == ["Who bought."] and e.get_context("deals")["tables"][0]["table"] == "sales"
    editor = Editor(store, lambda m: m.apply(spark, catalog), lambda: dt.date(2026, 9, 13))
    editor.edit_column("sales", "state", text="Stage of it.", synonyms="phase")
    assert "Stage of it." in str(editor.engine.describe_table("sales")) and editor.engine.get_context("which phase")["tables"][0]["table"] == "sales"


def test_problems_are_told_file_by_file(spark, catalog, store):
    assert store.load().problems(spark, catalog) == []
    (store.root / "tables/sales.md").write_text(SALES.replace("- state [", "- stage ["))
    (store.root / "glossary.md").write_text("# glossary\n\nformat: 1\n\n## Terms\n\n- Deal: A sale.\n  - tables: nothing\n")
    assert len(store.load().problems(spark, catalog)) == 2


def test_the_value_index_is_off_unless_written_on(spark, catalog, store):
    assert store.load().apply(spark, catalog).index_cap == 0
    (store.root / "project.md").write_text("# project\n\nformat: 1\nvalue_index: on\n")
    assert store.load().apply(spark, catalog).index_cap == 200


def test_an_edit_that_reads_back_otherwise_is_refused(spark, catalog, store):
    editor = Editor(store, lambda m: m.apply(spark, catalog))
    before = store.text("tables", "sales")
    with pytest.raises(MetadataError):
        editor.edit_table("sales", purpose="a\nsynonyms: b")
    assert store.text("tables", "sales") == before
