"""A tool server on standard input and output: one JSON-RPC message a line.

python -m minnow.server DATA TABLE[,TABLE] [--keys FILE] [--metadata FOLDER] [--tier standard]

The file of --keys is JSON: {"primary": {table: [column]}, "foreign": [{"table", "columns", "target", "target_columns"}]}.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from minnow import tools
from minnow.catalog import Catalog, ForeignKey
from minnow.editing import FULL, Workbench
from minnow.engine import Engine, Switches, as_text
from minnow.errors import KeyConfigError
from minnow.metadata import Editor, Metadata, Store
from minnow.sources.tables import parquet_dir

# Protocol version and error codes.
PROTOCOL = "2025-06-18"
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603


class Refused(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key comes twice")
    return dict(pairs)


def no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def result(engine: Engine | Workbench, method: str, params: dict[str, Any], tier: str) -> dict:
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "minnow", "version": engine.catalog.fingerprint}, "instructions": tools.instructions(engine, tier)}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": tools.protocol(tier, engine)}
    if method == "tools/call":
        name, arguments = params.get("name"), params.get("arguments", {})
        if name not in tools.specs(tier, engine) or not isinstance(arguments, dict):
            raise Refused(PARAMS, "name is a listed tool and arguments is an object")
        out = tools.call(engine, name, arguments, tier)
        structured = {} if arguments.get("format") == "compact" else {"structuredContent": out}
        return {"content": [{"type": "text", "text": as_text(out, arguments)}], **structured, "isError": "error" in out}
    raise Refused(METHOD, f"unknown method {method!r}")


def answer(engine: Engine | Workbench, line: str, tier: str = "standard") -> str | None:
    """The reply to a line; None for a notification."""
    key = None
    try:
        try:
            message = json.loads(line, parse_constant=no_constant, object_pairs_hook=unique)
        except (ValueError, RecursionError):
            raise Refused(PARSE, "the line is no JSON") from None
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            raise Refused(REQUEST, "the message is no request")
        if "id" not in message:
            return None
        if isinstance(message["id"], bool) or not isinstance(message["id"], (str, int)):
            raise Refused(REQUEST, "id is a text or a whole number")
        key, params = message["id"], message.get("params", {})
        if not isinstance(params, dict):
            raise Refused(PARAMS, "params is an object")
        reply = {"result": result(engine, message["method"], params, tier)}
    except Refused as e:
        reply = {"error": {"code": e.code, "message": str(e)}}
    except Exception:  # noqa: BLE001 - the caller learns nothing of the cause
        reply = {"error": {"code": INTERNAL, "message": "internal error"}}
    return json.dumps({"jsonrpc": "2.0", "id": key} | reply, ensure_ascii=False, allow_nan=False)


def keys(text: str) -> tuple[dict[str, tuple[str, ...]], list[ForeignKey]]:
    """Primary and foreign keys from the JSON of --keys."""
    try:
        found = json.loads(text)
        primary = {t: tuple(c) for t, c in found.get("primary", {}).items()}
        return primary, [ForeignKey(k["table"], tuple(k["columns"]), k["target"], tuple(k.get("target_columns", ()))) for k in found.get("foreign", [])]
    except (ValueError, KeyError, TypeError, AttributeError):
        raise KeyConfigError("the file of keys is {primary: {table: [column]}, foreign: [{table, columns, target, target_columns}]}") from None


def main() -> None:
    p = argparse.ArgumentParser(description="Serve tables of a Parquet folder as tools.")
    p.add_argument("data")
    p.add_argument("tables", type=lambda x: x.split(","))
    p.add_argument("--keys")
    p.add_argument("--metadata")
    p.add_argument("--tier", choices=tools.ALL_TIERS, default="standard")
    a = p.parse_args()
    if a.tier == FULL and not a.metadata:
        p.error("--tier full edits the files of --metadata")
    spark = SparkSession.builder.appName("minnow").getOrCreate()
    primary, foreign = keys(Path(a.keys).read_text(encoding="utf-8")) if a.keys else ({}, [])
    catalog = Catalog(parquet_dir(spark, a.data, a.tables), primary, foreign)
    engine: Engine | Workbench
    if a.tier == FULL:
        engine = Workbench(Editor(Store(a.metadata), lambda m: m.apply(spark, catalog, switches=Switches(allow_metadata_writes=True))))
    else:
        engine = (Store(a.metadata).load() if a.metadata else Metadata()).apply(spark, catalog)
    for line in sys.stdin:
        if line.strip() and (reply := answer(engine, line, a.tier)) is not None:
            print(reply, flush=True)


if __name__ == "__main__":
    main()
