"""Thin transports around the surfaces: HTTP, and tool calls over standard input and output (JSON-RPC lines).

HTTP: ``GET /health``; ``GET /t/<tenant>/context/<surface>?path=...&limit=...``
gives an envelope; ``POST /t/<tenant>/query`` runs the body as read-only SQL.
With a key, requests need it as a bearer token. Everything heavy stays in Spark.
"""

from __future__ import annotations

import hmac
import json
import re
import sys
from collections.abc import Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession

from orebody.plans import render, surfaces

NUMBERS = ("limit", "days")
SQL_ROWS = 10_000
READS = re.compile(r"^\s*(?:--[^\n]*\n\s*)*(?:select|with|values|show|describe|explain)\b", re.IGNORECASE)

#: tool -> (surface, what it answers, required parameters)
TOOLS = {
    "get_ownership": ("ownership", "Who owns a file or folder, by surviving lines", ()),
    "suggest_reviewers": ("reviewers", "Who should review a change to a path", ("path",)),
    "get_coupling": ("blast_radius", "What usually changes together with a path", ("path",)),
    "get_activity": ("activity", "Change figures of a recent window", ()),
    "get_contributors": ("contributors", "Who has worked on a path", ()),
    "search_code": ("search", "Symbols, paths and commits by exact text", ("query",)),
    "get_graph": ("graph", "Which files use which", ()),
    "get_dependencies": ("dependencies", "Declared third-party dependencies", ()),
    "get_risks": ("risks", "Ranked risk findings", ()),
    "get_markers": ("markers", "Technical-debt markers", ()),
}


class BadRequest(ValueError):
    """A request that names something unknown or leaves something out."""


def parameters(given: Mapping[str, object]) -> dict:
    """Known parameters with their types; empty ones are dropped."""
    out: dict = {}
    for k, v in given.items():
        if k not in ("path", "query", *NUMBERS):
            raise BadRequest(f"unknown parameter {k}")
        if v in (None, ""):
            continue
        try:
            out[k] = int(v) if k in NUMBERS else str(v)
        except (TypeError, ValueError):
            raise BadRequest(f"{k} must be a number") from None
    return out


def ask(tables: Mapping[str, DataFrame], surface: str, given: Mapping[str, object], tenant: str = "local") -> dict:
    if surface not in surfaces.SURFACES:
        raise BadRequest(f"unknown surface {surface}")
    params = parameters(given)
    needed = next((n for s, _, n in TOOLS.values() if s == surface), ())
    if missing := [n for n in needed if n not in params]:
        raise BadRequest(f"missing parameter {missing[0]}")
    try:
        return surfaces.envelope(surface, tables, tenant, **params)
    except TypeError:
        raise BadRequest(f"a parameter does not apply to {surface}") from None


def run_sql(spark: SparkSession, text: str) -> dict:
    """At most SQL_ROWS rows of one reading statement over the registered views."""
    if not READS.match(text) or ";" in text.strip().rstrip(";"):
        raise BadRequest("only one reading statement is allowed")
    rows = [r.asDict(True) for r in spark.sql(text.strip().rstrip(";")).limit(SQL_ROWS + 1).collect()]
    return {"rows": rows[:SQL_ROWS], "row_count": min(len(rows), SQL_ROWS), "truncated": len(rows) > SQL_ROWS}


def http_server(spark: SparkSession, tables: Mapping[str, DataFrame], host: str = "127.0.0.1", port: int = 0, key: str | None = None) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def reply(self, status: int, body: dict) -> None:
            raw = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def handle_with(self, act) -> None:
            if key and not hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {key}"):
                return self.reply(401, {"error": "a valid key is needed"})
            try:
                self.reply(200, act())
            except BadRequest as e:
                self.reply(400, {"error": str(e)})
            except Exception as e:  # the caller learns what Spark says in one line
                self.reply(500, {"error": str(e).split("\n")[0]})

        def do_GET(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/health":
                return self.reply(200, {"status": "ok"})
            m = re.fullmatch(r"/t/([^/]+)/context/(\w+)", url.path)
            if not m:
                return self.reply(404, {"error": "no such path"})
            self.handle_with(lambda: ask(tables, m[2], dict(parse_qsl(url.query)), m[1]))

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            if not re.fullmatch(r"/t/[^/]+/query", self.path):
                return self.reply(404, {"error": "no such path"})
            self.handle_with(lambda: run_sql(spark, body))

    return ThreadingHTTPServer((host, port), Handler)


def tool_list() -> list[dict]:
    kind = lambda p: {"type": "integer" if p in NUMBERS else "string"}
    return [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {p: kind(p) for p in ("path", "query", *NUMBERS)}, "required": list(req)}} for n, (_, d, req) in TOOLS.items()]


def tool_call(tables: Mapping[str, DataFrame], message: dict) -> dict | None:
    """The answer to one JSON-RPC message, or None for a notification."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    answer = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return answer | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "orebody", "version": "1"}}}
    if method == "tools/list":
        return answer | {"result": {"tools": tool_list()}}
    if method == "ping":
        return answer | {"result": {}}
    if method != "tools/call":
        return answer | {"error": {"code": -32601, "message": f"unknown method {method}"}}
    try:
        if params.get("name") not in TOOLS:
            raise BadRequest(f"unknown tool {params.get('name')}")
        said, failed = render.render(ask(tables, TOOLS[params["name"]][0], params.get("arguments") or {})), False
    except Exception as e:  # errors are an answer here, not a broken connection
        said, failed = str(e).split("\n")[0], True
    return answer | {"result": {"content": [{"type": "text", "text": said}], "isError": failed}}


def serve_lines(tables: Mapping[str, DataFrame], source=sys.stdin, sink=sys.stdout) -> None:
    for line in source:
        if line.strip() and (answer := tool_call(tables, json.loads(line))) is not None:
            sink.write(json.dumps(answer) + "\n")
            sink.flush()
