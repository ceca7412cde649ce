import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from minnow import context, tools
from minnow.catalog import Catalog, ForeignKey, Kind
from minnow.engine import Engine, Switches, Tool, cell
from minnow.errors import EngineError, LimitExceededError, QuerySpecError, SensitiveColumnError, SourceError, ToolConfigError, UnknownNameError, UnknownToolError
from minnow.functions import text as X
from minnow.notes import ColumnNote, TableNote, Term
from minnow.operators import retrieval, search
from minnow.plans.planner import Policy
from minnow.plans.spec import Filter, Measure, QuerySpec
from minnow.sources import jdbc
from minnow.sources.tables import folded, spark_catalog


@pytest.fixture(scope="module")
def shop(spark):
    frames = {
        "buyers": spark.createDataFrame([(1, "Ann Lee", "north", "x"), (2, "Bob Ray", None, "y"), (3, "Cid Fox", "south", "z")], "id long, name string, area string, secret string"),
        "sales": spark.createDataFrame([(1, 1, 1, "open", 10.5, dt.datetime(2026, 9, 1)), (2, 1, 2, "done", 20.0, dt.datetime(2026, 7, 1)), (3, 2, 1, "open", 5.0, dt.datetime(2026, 9, 9)), (4, 9, 1, "open", 1.0, None)], "id long, buyer_id long, payer_id long, state string, amount double, at timestamp_ntz"),
        "staff": spark.createDataFrame([(1, None, "Top"), (2, 1, "Low")], "id long, boss_id long, name string"),
    }
    keys = (ForeignKey("sales", ("buyer_id",), "buyers"), ForeignKey("sales", ("payer_id",), "buyers"), ForeignKey("staff", ("boss_id",), "staff"))
    return Catalog(frames, {"buyers": ("id",), "sales": ("id",), "staff": ("id",)}, keys)


def make(spark, shop, **more):
    return Engine(spark, shop, now=lambda: dt.datetime(2026, 9, 13), searchable={"buyers": ("name",)}, **more)


def test_relationship_names(shop):
    names = {(r.source, r.name, r.to_many) for r in shop.relationships}
    assert ("sales", "buyers_via_buyer_id", False) in names and ("sales", "buyers_via_payer_id", False) in names
    assert ("staff", "staff_via_boss_id", False) in names and ("staff", "staff_via_boss_id_to_many", True) in names


def test_rows_joins_and_unmatched(spark, shop):
    e = make(spark, shop)
    out = e.query(table="sales", columns=["id", "buyers_via_buyer_id.name", "buyers_via_payer_id.name"])
    assert out["rows"] == [[1, "Ann Lee", "Ann Lee"], [2, "Ann Lee", "Bob Ray"], [3, "Bob Ray", "Ann Lee"], [4, None, "Ann Lee"]]
    assert e.query(table="sales", columns=["id"], filters=[{"column": "buyers_via_buyer_id.id", "op": "is_null"}])["rows"] == [[4]]
    assert e.query(table="sales", columns=["id"], limit=2)["truncated"] is True


def test_nulls_and_dates(spark, shop):
    e = make(spark, shop)
    assert e.query(table="buyers", columns=["id"], filters=[{"column": "area", "op": "ne", "value": "north"}])["rows"] == [[3]]
    assert e.query(table="sales", columns=["id"], filters=[{"column": "at", "op": "since_days", "value": 30}])["rows"] == [[1], [3]]
    with pytest.raises(QuerySpecError):
        e.plan_query({"table": "sales", "filters": [{"column": "at", "op": "gt", "value": "soon"}]})


def test_groups(spark, shop):
    out = make(spark, shop).query(table="sales", group_by=["state"], measures=[{"fn": "sum", "column": "amount"}, {"fn": "count"}])
    assert out["columns"] == ["state", "sum_amount", "count"] and out["rows"] == [["done", 20.0, 1], ["open", 16.5, 3]]
    assert make(spark, shop).query(table="sales", measures=[{"fn": "count"}])["rows"] == [[4]]


def test_hidden_is_missing_and_sensitive_is_refused_everywhere(spark, shop):
    e = make(spark, shop, policy=Policy(frozenset({("buyers", "secret")}), frozenset({("buyers", "area")})))
    assert [c["name"] for c in e.describe_table("buyers")["columns"]] == ["id", "name", "area"]
    assert e.query(table="buyers")["columns"] == ["id", "name"]
    for name, error in (("secret", UnknownNameError), ("nothing", UnknownNameError), ("area", SensitiveColumnError)):
        for spec in (
            {"table": "buyers", "columns": [name]}, {"table": "buyers", "filters": [{"column": name, "op": "not_null"}]}, {"table": "buyers", "order": [{"by": name}]},
            {"table": "buyers", "group_by": [name]}, {"table": "buyers", "measures": [{"fn": "count", "column": name}]}, {"table": "sales", "columns": [f"buyers_via_buyer_id.{name}"]},
        ):
            with pytest.raises(error) as found:
                e.plan_query(spec)
            assert "secret" not in found.value.suggestions


def test_scope_is_applied_and_unseen(spark, shop):
    e = make(spark, shop, policy=Policy(frozenset({("buyers", "secret")})), scope=lambda t: (Filter("secret", "ne", "x"),) if t == "buyers" else ())
    assert e.query(table="buyers", columns=["id"])["rows"] == [[2], [3]]
    broken = make(spark, shop, scope=lambda t: (Filter("gone", "eq", 1),))
    assert "gone" not in broken.dispatch("query", {"table": "buyers"})["error"]["message"]


@pytest.mark.parametrize("spec", [
    {"table": "sales", "filters": [{"column": "amount", "op": "like", "value": 1}]}, {"table": "sales", "filters": [{"column": "amount", "op": "between", "value": [1]}]},
    {"table": "sales", "filters": [{"column": "amount", "op": "eq", "value": "a"}]}, {"table": "sales", "filters": [{"column": "amount", "op": "eq", "value": True}]},
    {"table": "sales", "filters": [{"column": "state", "op": "since_days", "value": 1}]}, {"table": "sales", "measures": [{"fn": "sum", "column": "state"}]},
    {"table": "sales", "colums": ["id"]}, {"table": "sales", "columns": ["id"], "measures": [{"fn": "count"}]}, {"table": "sales", "limit": 0}, {"table": "sales", "limit": 501},
    {"table": "sales", "group_by": ["state", "id", "amount"]}, {"table": "sales", "columns": ["a.b.c.d"]}, {"table": "sales", "filters": [{"column": "id", "op": "in", "value": list(range(101))}]},
    {"table": "sales", "group_by": ["state"], "measures": [{"fn": "count"}], "order": [{"by": "amount"}]},
])
def test_refused(spark, shop, spec):
    with pytest.raises(EngineError):
        make(spark, shop).plan_query(spec)
    assert "error" in make(spark, shop).dispatch("query", spec)


def test_suggestions_and_context(spark, shop):
    e = make(spark, shop, index_cap=50)
    assert e.dispatch("query", {"table": "bayers"})["error"]["suggestions"] == ["buyers"]
    assert any("open" in n for n in e.query(table="sales", filters=[{"column": "state", "op": "eq", "value": "opn"}])["notes"])
    found = e.get_context("which sales are open in the north area")
    assert found["tables"][0]["table"] in ("sales", "buyers") and {v["value"] for v in found["values"]} >= {"open", "north"}
    assert e.search_rows("buyers", "lea an")["rows"][0][1] == "Ann Lee"


def test_plan_has_no_python_and_prunes(spark, shop):
    plan = make(spark, shop).plan_query({"table": "sales", "group_by": ["buyers_via_buyer_id.area"], "measures": [{"fn": "sum", "column": "amount"}]})
    text = plan.df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Cartesian" not in text
    assert QuerySpec.of({"table": "x"}).limit is None and shop.tables["sales"].column("at").kind is Kind.DATETIME
    with pytest.raises(LimitExceededError):
        make(spark, shop).plan_query({"table": "sales", "columns": ["buyers_via_buyer_id.sales_via_buyer_id.buyers_via_buyer_id.name"]})


def plain_soundex(word):
    codes = {c: str(i) for i, group in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in group}
    letters = [c for c in word.upper() if "A" <= c <= "Z"]
    if not letters:
        return None
    out, last = letters[0], codes.get(letters[0], "")
    for c in letters[1:]:
        if c in "HW":
            continue
        if (code := codes.get(c, "")) and code != last:
            out += code
        last = code
    return (out + "000")[:4]


def test_soundex_and_tokens(spark):
    r = random.Random(3)
    words = ["", "123", "Robert", "Rupert", "Ashcraft", "Tymczak", "Pfister", "Honeyman", *("".join(r.choice("abcdefghijklmnopqrstuvwxyz1'") for _ in range(r.randint(1, 9))) for _ in range(300))]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.soundex(F.col("w")).alias("s")).collect()
    assert all(x["s"] == plain_soundex(x["w"]) for x in got)
    t = spark.range(1).select(X.tokens(F.lit("the HTTPServer boxesOf classes parties order_items is")).alias("t")).first()["t"]
    assert t == ["http", "server", "boxe", "class", "party", "order", "item"]
    s = spark.range(1).select(F.round(X.trigram_similarity(F.lit("word"), F.lit("two words")), 4).alias("s")).first()["s"]
    assert s == 0.3636


def test_cells():
    assert cell(dt.datetime(2026, 1, 2, 3, 4, 5, 6), 9) == "2026-01-02 03:04:05" and cell(b"abc", 9) == "<3 bytes>" and cell(float("nan"), 9) == "nan" and cell("abcdef", 3) == "abc…"


WRONG = [
    ("query", {"table": "sales", "filters": [{"column": "id", "op": "eq", "value": 10**30}]}), ("query", {"table": "sales", "filters": [{"column": "amount", "op": "eq", "value": float("inf")}]}),
    ("query", {"table": "odd", "filters": [{"column": "pair", "op": "eq", "value": "x"}]}), ("query", {"table": "odd", "filters": [{"column": "raw", "op": "eq", "value": "x"}]}),
    ("query", {"table": "odd", "filters": [{"column": "raw", "op": "in", "value": ["x"]}]}), ("query", {"table": "odd", "group_by": ["pair"]}), ("query", {"table": "odd", "columns": ["id"], "order": [{"by": "bag"}]}),
    ("query", {"table": "odd", "measures": [{"fn": "count_distinct", "column": "bag"}]}), ("query", {"table": 5}), ("query", {"table": None}), ("query", {}), ("query", {"table": "sales", "columns": "id"}),
    ("query", {"table": "sales", "columns": [5]}), ("query", {"table": "sales", "filters": {"column": "id"}}), ("query", {"table": "sales", "filters": [5]}), ("query", {"table": "sales", "filters": [{"column": "id"}]}),
    ("query", {"table": "sales", "filters": [{"column": "id", "op": ["eq"], "value": 1}]}), ("query", {"table": "sales", "concepts": [5]}), ("query", {"table": "sales", "limit": "5"}), ("query", {"table": "sales", "limit": True}),
    ("query", {"table": "sales", "measures": [{"fn": "count", "alias": 5}]}), ("query", {"table": "sales", "filters": [{"column": "at", "op": "since_days", "value": 10**9}]}), ("query", {"table": "sales", "format": "xml"}),
    ("describe_table", {"table": None}), ("describe_table", {"table": 5}), ("describe_table", {}), ("describe_table", {"table": "sales", "format": 5}), ("describe_table", {"tabel": "sales"}), ("list_tables", {"x": 1}),
    ("get_context", {"question": 5}), ("get_context", {"question": ""}), ("get_context", {"question": "x" * 2001}), ("get_context", {"question": "x", "budget_tokens": 0}), ("get_context", {"question": "x", "budget_tokens": 8001}),
    ("search_rows", {"table": "buyers", "term": 5}), ("search_rows", {"table": "buyers", "term": "a", "columns": "name"}), ("search_rows", {"table": "buyers", "term": "a", "match": "some"}), ("search_rows", {"table": "sales", "term": "a"}),
    ("search_rows", {"table": "buyers", "term": "a", "strategies": ["luck"]}), ("search_rows", {"table": "buyers", "term": "a", "limit": 0}), ("search_rows", {"table": "buyers", "term": "a", "columns": ["area"]}), ("search_rows", {"table": "buyers", "term": " "}),
    ("drop", {}), ("query", None), ("query", [1]),
]


@pytest.fixture(scope="module")
def odd(spark, shop):
    frame = spark.createDataFrame([(1, (1, "a"), {"k": 1}, bytearray(b"x"))], "id long, pair struct<a:int,b:string>, bag map<string,int>, raw binary")
    return Catalog({**shop.tables.frames, "odd": frame}, {**shop.keys, "odd": ("id",)}, shop.foreign_keys)


@pytest.mark.parametrize(("tool", "arguments"), WRONG)
def test_nothing_escapes_dispatch(spark, odd, tool, arguments):
    error = make(spark, odd).dispatch(tool, arguments)["error"]
    assert set(error) == {"type", "message", "suggestions"} and error["type"].endswith("Error") and "JVM" not in error["message"] and len(error["message"]) < 300


def test_odd_kinds_can_still_be_read(spark, odd):
    e = make(spark, odd)
    assert e.query(table="odd", columns=["id"], filters=[{"column": "raw", "op": "not_null"}])["rows"] == [[1]]
    assert e.query(table="odd", measures=[{"fn": "count", "column": "bag"}])["rows"] == [[1]] and e.query(table="odd")["columns"] == ["id", "pair", "bag"]


NOTES = {
    "buyers": TableNote("People who buy.", "One row a person.", ("customers", "clients"), {"area": ColumnNote("Where they live.", ("north", "south"), ("region",)), "secret": ColumnNote("Hidden words.", (), ("cipher",))}),
    "sales": TableNote("What was sold.", columns={"state": ColumnNote("How far it is.", tuple(f"v{i}" for i in range(12)))}, concepts={"pending": "Not done."}),
}


def noted(spark, shop, **more):
    policy = Policy(frozenset({("buyers", "secret")}), frozenset({("buyers", "name")}))
    return make(spark, shop, notes=NOTES, policy=policy, concepts={("sales", "pending"): (Filter("state", "eq", "open"),)}, glossary=(Term("harp music", "Strings."), Term("revenue", "Money.", ("turnover",), ("sales",))), **more)


def test_cards_say_what_is_known(spark, shop):
    card = noted(spark, shop).describe_table("buyers")
    assert card["synonyms"] == ["customers", "clients"] and card["description"] == "One row a person."
    area = next(c for c in card["columns"] if c["name"] == "area")
    assert area == {"name": "area", "kind": "text", "type": "string", "text": "Where they live.", "values": ["north", "south"], "synonyms": ["region"]}
    assert next(c for c in card["columns"] if c["name"] == "name")["sensitive"] and "secret" not in str(card)
    sales = noted(spark, shop).describe_table("sales")
    assert next(c for c in sales["columns"] if c["name"] == "buyer_id")["references"] == "buyers.id" and sales["concepts"] == [{"name": "pending", "text": "Not done."}]
    hidden = make(spark, shop, policy=Policy(frozenset({("buyers", "id")})))
    assert "references" not in str(hidden.describe_table("sales")["columns"])
    text = noted(spark, shop).dispatch_text("describe_table", {"table": "sales", "format": "compact"})
    assert "- state text: How far it is. (v0, v1, v2, v3, v4, v5, v6, v7, ...)" in text and "{" not in text


def test_context_uses_all_that_is_written(spark, shop):
    e = noted(spark, shop)
    first = lambda question, e=e: e.get_context(question)["tables"][0]["table"]
    assert first("list the clients") == "buyers" and first("which region") == "buyers" and first("our turnover") == "sales" and first("pending ones") == "sales"
    assert e.get_context("about a carp")["glossary"] == {} and e.get_context("some harp")["glossary"] == {"harp music": "Strings."}
    assert not e.get_context("the cipher")["tables"]
    small = e.get_context("sales", budget_tokens=40)
    assert small["used_tokens"] <= 40 and small["also"] and not small["tables"]


def test_python_tokens_are_those_of_the_columns(spark):
    r = random.Random(9)
    texts = ["HTTPServer boxesOf classes parties order_items ties flies gas glass", *(" ".join("".join(r.choice("abcesiXYZ19_") for _ in range(r.randint(1, 8))) for _ in range(6)) for _ in range(200))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.tokens(F.col("t")).alias("w")).collect()
    assert all(context.tokens(x["t"]) == x["w"] for x in got)


def test_driver_ranking_is_that_of_the_operators(spark, shop):
    cards = noted(spark, shop).cards
    texts = {t.name: cards.texts(t) for t in shop.tables.values()}
    frame = spark.createDataFrame([(k, *v.values()) for k, v in texts.items()], "table string, " + ", ".join(f"{f} string" for f in context.FIELDS))
    for question in ("clients of the north area", "pending sale revenue of buyers", "staff boss name name"):
        asked = context.tokens(question)
        scored = retrieval.bm25(frame, "table", asked, context.FIELDS)
        want = [x["table"] for x in scored.orderBy(F.desc("score"), "table").collect()]
        assert context.by_words(asked, texts) == want


def test_vectors_are_a_third_source(spark, shop):
    asked = []

    def embed(texts):
        asked.append(list(texts))
        return [[3.0, 0.0] if "boss" in t or "manager" in t else [0.0, 2.0] for t in texts]

    e = noted(spark, shop, embed=embed)
    assert [t["table"] for t in e.get_context("the manager")["tables"]] == ["staff"]
    assert len(asked[0]) == 3 and "cipher" not in str(asked) and "Ann" not in str(asked)
    e.get_context("the manager")
    assert [len(x) for x in asked] == [3, 1, 1]  # the tables' texts are embedded once
    for bad in (lambda t: [[1.0]], lambda t: [[1.0] * (i + 1) for i in range(len(t))], lambda t: [[float("nan")] for _ in t]):
        assert noted(spark, shop, embed=bad).dispatch("get_context", {"question": "x"})["error"]["type"] == "EmbeddingError"


def test_value_index(spark, tmp_path):
    long = "x" * 80
    frame = spark.createDataFrame([(f"{long}{i % 3}",) for i in range(9)] + [(None,), ("a",), ("a",), ("a",), ("a",)], "v string")
    rows = {(r["value"], r["n"], r["rank"], r["complete"]) for r in retrieval.value_index(frame, "t", ["v"], cap=4).collect()}
    assert rows == {("a", 4, 1, True), (long, 3, 2, True), (long, 3, 3, True), (long, 3, 4, True)}
    assert {r["complete"] for r in retrieval.value_index(frame, "t", ["v"], cap=3, samples=2).collect()} == {False}
    seen = []
    make = lambda **more: Engine(spark, Catalog({"t": frame}), audit=seen.append, **more)
    assert make().get_context("about a")["values"] == [] and not seen  # off unless asked for
    first = make(index_cap=10, cache_dir=tmp_path)
    assert first.value_index().count() == 4 and [s.command for s in seen] == ["value_index"]
    assert make(index_cap=10, cache_dir=tmp_path).value_index().count() == 4 and len(seen) == 1
    assert make(index_cap=2, cache_dir=tmp_path).value_index().count() == 2 and len(seen) == 2
    next(tmp_path.glob("*.json")).write_text("{")
    assert make(index_cap=10, cache_dir=tmp_path).value_index().count() == 4 and len(seen) == 3


def test_search_defaults(spark, shop):
    assert search.available(spark) == search.DEFAULT == ("contains", "soundex", "levenshtein", "trigram", "fulltext")
    e = make(spark, shop)
    assert e.search_rows("buyers", "lea")["rows"][0][1] == "Ann Lee" and e.search_rows("Buyers", "lea")["searched"] == ["name"]
    plain = make(spark, shop, fulltext=frozenset())
    assert plain.search_rows("buyers", "ray", strategies=["fulltext"])["rows"] == plain.search_rows("buyers", "ray", strategies=["contains"])["rows"]
    assert [r[0] for r in make(spark, shop, fulltext=frozenset({("buyers", "name")})).search_rows("buyers", "rays", strategies=["fulltext"])["rows"]] == [2]
    assert make(spark, shop).search_rows("buyers", "rays", strategies=["fulltext"])["rows"] == []  # not flagged: looked for as a part


def test_switches_tools_and_refresh(spark, shop):
    hello = Tool("hello", "Says hello.", {"type": "object", "properties": {"name": {"type": "string"}}, "required": ["name"]}, lambda name: {"said": f"hello {name}"})
    change = Tool("change", "Changes.", {"type": "object", "properties": {}}, dict, mutating=True)
    e = make(spark, shop, custom=(hello, change), index_cap=50, switches=Switches(diagnose_empty_results=False, reveal_request=True, include_row_estimates=False))
    assert e.dispatch("hello", {"name": "x"})["said"] == "hello x" and "error" in e.dispatch("hello", {}) and "error" in e.dispatch("hello", {"nom": "x"})
    assert "change" not in e.tools() and "change" in make(spark, shop, custom=(change,), switches=Switches(allow_metadata_writes=True)).tools()
    out = e.query(table="sales", columns=["id"], filters=[{"column": "state", "op": "eq", "value": "opn"}])
    assert out["notes"] == [] and "opn" not in out["request"] and "rows" not in e.list_tables()["tables"][0]
    with pytest.raises(ToolConfigError):
        make(spark, shop, custom=(Tool("query", "x", {"type": "object"}, dict),))
    assert e.run("list_tables") == e.list_tables() and e.refresh() is e
    with pytest.raises(UnknownToolError):
        e.run("nothing")


def test_failures_are_audited(spark, shop):
    seen = []
    frame = spark.range(3).select("id", F.expr("raise_error(concat('no ', id))").cast("string").alias("v"))
    e = Engine(spark, Catalog({"bad": frame}, {"bad": ("id",)}), audit=seen.append)
    assert e.dispatch("query", {"table": "bad"})["error"]["type"] == "ExecutionError" and [s.rows for s in seen] == [None]


def test_tables_are_read_when_they_are_asked_for(spark, shop):
    opened = []

    def lazy(name):
        def load():
            opened.append(name)
            return shop.tables[name].frame

        return load

    c = Catalog({n: lazy(n) for n in shop.tables}, shop.keys, shop.foreign_keys)
    Engine(spark, c).plan_query({"table": "sales", "columns": ["id", "buyers_via_payer_id.name"]})
    assert opened == ["sales", "buyers"]
    assert c.fingerprint == shop.fingerprint and sorted(opened) == sorted(shop.tables)


def test_database_keys():
    name = lambda s, t: t if s == "public" else f"{s}.{t}"
    row = lambda kind, n, s, t, c, i, *to: dict(zip(("kind", "name", "s", "t", "col", "place", "target_s", "target_t", "target_col"), (kind, n, s, t, c, i, *(to or (None,) * 3)), strict=True))
    rows = [
        row("PRIMARY KEY", "pk_l", "public", "lines", "no", 2), row("PRIMARY KEY", "pk_l", "public", "lines", "order_id", 1), row("PRIMARY KEY", "pk_o", "shop", "orders", "id", 1),
        row("FOREIGN KEY", "fk", "public", "lines", "order_id", 1, "shop", "orders", "id"), row("FOREIGN KEY", "gone", "public", "lines", "no", 1),
    ]
    primary, foreign = jdbc.keys_of(rows, name)
    assert primary == {"lines": ("order_id", "no"), "shop.orders": ("id",)} and foreign == [ForeignKey("lines", ("order_id",), "shop.orders", ("id",))]
    assert jdbc.dialect_of("jdbc:postgresql://h/db") == "postgresql" and folded([("db", "a"), ("x", "a")], "db") == {"a": "db.a", "x.a": "x.a"}
    for bad in (lambda: jdbc.dialect_of("jdbc:oracle:x"), lambda: folded([("db", "a"), ("db", "A")], "db")):
        with pytest.raises(SourceError):
            bad()


def test_spark_catalog_views(spark, shop):
    shop.tables["buyers"].frame.createOrReplaceTempView("some_buyers")
    frames = spark_catalog(spark)
    assert Catalog(frames).table("SOME_BUYERS").frame.count() == 3


def test_sizes_of_answers(spark):
    """Five tables, described: answers and definitions stay under fixed numbers of bytes."""
    names = ("regions", "customers", "products", "orders", "order_lines")
    frame = lambda n: spark.createDataFrame([], f"id long, name string, status string, amount double, {n[0]}_id long, created_at timestamp")
    notes = {n: TableNote(f"What the shop knows of its {n.replace('_', ' ')}.", f"One row for each of the {n}.", (n.upper(),), {"status": ColumnNote("How far it is.", ("open", "paid", "shipped")), "name": ColumnNote("What people call it.")}) for n in names}
    keys = [ForeignKey("customers", ("c_id",), "regions"), ForeignKey("orders", ("o_id",), "customers"), ForeignKey("order_lines", ("o_id",), "orders")]
    e = Engine(spark, Catalog({n: frame(n) for n in names}, {n: ("id",) for n in names}, keys, row_estimates=dict.fromkeys(names, 1000)), notes=notes, concepts={("orders", "active"): (Filter("status", "eq", "open"),)}, measures={("orders", "revenue"): Measure("sum", "amount")}, searchable={"customers": ("name",)})
    question = "Which open orders does the customer called Acme have by region?"
    for tool, arguments, most, compact in (("describe_table", {"table": "orders"}, 1800, 900), ("get_context", {"question": question}, 4200, 1400), ("list_tables", {}, 1800, 300), ("query", {"table": "orders", "group_by": ["status"], "measures": [{"fn": "count"}]}, 400, 200)):
        assert len(e.dispatch_text(tool, arguments)) < most, tool
        assert len(e.dispatch_text(tool, arguments | {"format": "compact"})) < compact, tool
    assert len(json.dumps(tools.plain("standard", e))) < 9000 and len(json.dumps(tools.plain("minimal", e))) < 4895 and len(tools.instructions(e)) < 1800
