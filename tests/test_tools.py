import inspect
import json

import pytest

from minnow import server, tools
from minnow.catalog import Catalog
from minnow.engine import TIERS, Engine
from minnow.errors import KeyConfigError


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, Catalog({"fish": spark.createDataFrame([(1, "carp"), (2, "pike")], "id long, name string")}, {"fish": ("id",)}))


@pytest.mark.parametrize("tier", TIERS)
def test_schemas_name_the_arguments_of_the_tools(engine, tier):
    found = tools.specs(tier)
    assert set(found) == set(engine.tools(tier))
    for name, (_, schema) in found.items():
        if name != "query":
            parameters = inspect.signature(engine.tools(tier)[name]).parameters
            assert set(schema["properties"]) == set(parameters)
            assert schema["required"] == [k for k, p in parameters.items() if p.default is p.empty]
    assert len(json.dumps(tools.plain(tier))) < 9000 and len(tools.instructions(engine, tier)) < 1800


def test_strict_schemas_require_everything():
    (query,) = [x["function"]["parameters"] for x in tools.function_calling() if x["function"]["name"] == "query"]
    assert query["required"] == list(query["properties"])
    item = query["properties"]["filters"]["anyOf"][0]["items"]
    assert item["required"] == ["column", "op", "value"] and item["additionalProperties"] is False


def test_nulls_of_strict_callers_are_left_out(engine):
    out = tools.call(engine, "query", {"table": "fish", "columns": ["name"], "filters": [{"column": "id", "op": "not_null", "value": None}], "limit": None, "measures": None})
    assert out["rows"] == [["carp"], ["pike"]]


def ask(engine, message, tier="standard"):
    reply = server.answer(engine, message if isinstance(message, str) else json.dumps({"jsonrpc": "2.0", "id": 7} | message), tier)
    return json.loads(reply) if reply else reply


def test_server(engine):
    assert ask(engine, {"method": "initialize"})["result"]["serverInfo"]["name"] == "minnow"
    assert ask(engine, {"method": "ping"}) == {"jsonrpc": "2.0", "id": 7, "result": {}}
    assert len(ask(engine, {"method": "tools/list"}, "minimal")["result"]["tools"]) == 2
    good = ask(engine, {"method": "tools/call", "params": {"name": "query", "arguments": {"table": "fish", "measures": [{"fn": "count"}]}}})["result"]
    assert good["isError"] is False and json.loads(good["content"][0]["text"])["rows"] == [[2]]
    assert ask(engine, {"method": "tools/call", "params": {"name": "query", "arguments": {"table": "bird"}}})["result"]["isError"] is True
    assert server.answer(engine, '{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None


@pytest.mark.parametrize(("message", "code"), [
    ("{", -32700), ('{"a": NaN}', -32700), ('{"a": 1, "a": 2}', -32700), ("[]", -32600), ('{"jsonrpc": "2.0", "id": true, "method": "ping"}', -32600),
    ({"method": "nothing"}, -32601), ({"method": "ping", "params": []}, -32602), ({"method": "tools/call", "params": {"name": "drop"}}, -32602),
])
def test_server_errors(engine, message, code):
    assert ask(engine, message)["error"]["code"] == code


def test_describe_is_refused_below_its_tier(engine):
    assert ask(engine, {"method": "tools/call", "params": {"name": "list_tables"}}, "minimal")["error"]["code"] == -32602


def test_compact_answers_are_text(engine):
    asked = {"method": "tools/call", "params": {"name": "query", "arguments": {"table": "fish", "format": "compact"}}}
    out = ask(engine, asked)["result"]
    assert out["content"][0]["text"] == "id|name\n1|carp\n2|pike" and "structuredContent" not in out


def test_keys_of_the_server():
    primary, foreign = server.keys('{"primary": {"a": ["id"]}, "foreign": [{"table": "b", "columns": ["a_id"], "target": "a"}]}')
    assert primary == {"a": ("id",)} and foreign[0].columns == ("a_id",) and server.keys("{}") == ({}, [])
    for bad in ("{", "[]", '{"foreign": [{}]}'):
        with pytest.raises(KeyConfigError):
            server.keys(bad)
