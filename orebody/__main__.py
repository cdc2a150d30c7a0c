"""Command line: index a repository, ask a surface, run SQL over an index.

    python -m orebody index REPO --out DIR [--level basic|mid|high] [--refs head|active|all|auto] [--full]
    python -m orebody ask DIR SURFACE [--path P] [--query Q] [--days N] [--limit N] [--json]
    python -m orebody sql DIR "SELECT ..."
    python -m orebody serve DIR [--port N] [--key K] | --tools
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from orebody.plans import build, render, service, surfaces


def session() -> SparkSession:
    spark = SparkSession.builder.appName("orebody").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="orebody")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("index")
    p.add_argument("repo")
    p.add_argument("--out", required=True)
    p.add_argument("--level", default="mid")
    p.add_argument("--refs", default="auto", choices=("head", "active", "all", "auto"))
    p.add_argument("--snapshots")
    p.add_argument("--chunk", type=int)
    p.add_argument("--full", action="store_true")
    p = sub.add_parser("ask")
    p.add_argument("index")
    p.add_argument("surface", choices=sorted(surfaces.SURFACES))
    p.add_argument("--path")
    p.add_argument("--query")
    p.add_argument("--days", type=int)
    p.add_argument("--limit", type=int)
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("sql")
    p.add_argument("index")
    p.add_argument("text")
    p = sub.add_parser("serve")
    p.add_argument("index")
    p.add_argument("--port", type=int, default=8765)
    p.add_argument("--key")
    p.add_argument("--tools", action="store_true", help="answer tool calls on standard input instead of HTTP")
    a = parser.parse_args(args)
    spark = session()
    if a.command == "index":
        card = build.build_index(spark, a.repo, a.out, build.Options(level=a.level, refs=a.refs, snapshots=a.snapshots, chunk_average=a.chunk, full=a.full))
        print(f"{card['mode']} index [{card['level']}]: {card['total_rows']} rows in {card['table_count']} tables")
    elif a.command == "ask":
        tables = build.open_index(spark, a.index)
        found = surfaces.envelope(a.surface, tables, limit=a.limit, **{k: v for k, v in {"path": a.path, "query": a.query, "days": a.days}.items() if v is not None})
        print(json.dumps(found) if a.json else render.render(found))
    elif a.command == "serve":
        tables = build.open_index(spark, a.index)
        service.serve_lines(tables) if a.tools else service.http_server(spark, tables, port=a.port, key=a.key).serve_forever()
    else:
        build.open_index(spark, a.index)
        spark.sql(a.text).show(1000, truncate=False)


if __name__ == "__main__":
    main()
