import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from orebody.plans import queries, service, views


@pytest.fixture(scope="module")
def tables(spark):
    t = queries.Index(spark, "/root/testdata/sf0.001")
    found = {n: t[n] for n in ("commits", "authors", "identities", "files", "commit_files", "blame", "symbols", "symbol_refs", "module_deps", "insights")}
    views.register(spark, found)
    return found


@pytest.fixture(scope="module")
def base(spark, tables):
    server = service.http_server(spark, tables, key="k")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def call(url, data=None, key="k"):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=data, headers={"Authorization": f"Bearer {key}"}), timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http(base):
    assert call(f"{base}/health") == (200, {"status": "ok"})
    status, found = call(f"{base}/t/acme/context/contributors?limit=3&path=")
    assert status == 200 and found["tenant"] == "acme" and found["row_count"] == 3 and found["truncated"]
    assert call(f"{base}/t/acme/context/contributors", key="no")[0] == 401
    assert call(f"{base}/t/acme/context/nothing")[0] == 400 and call(f"{base}/t/acme/context/search")[0] == 400 and call(f"{base}/x")[0] == 404
    assert call(f"{base}/t/acme/context/graph?limit=x")[0] == 400
    assert call(f"{base}/t/acme/query", b"SELECT count(*) AS n FROM v_commits")[1]["rows"] == [{"n": 1500}]
    assert call(f"{base}/t/acme/query", b"DROP VIEW v_commits")[0] == 400


def test_tools(tables):
    asked = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search_code", "arguments": {"query": "fn12", "limit": 2}}}, {"id": 4, "method": "tools/call", "params": {"name": "search_code", "arguments": {}}}, {"id": 5, "method": "other"}]
    out = io.StringIO()
    service.serve_lines(tables, io.StringIO("".join(json.dumps(m) + "\n" for m in asked)), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5] and len(got[1]["result"]["tools"]) == 10
    assert "fn12" in got[2]["result"]["content"][0]["text"] and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601
