import duckdb
import pytest

from orebody.plans import git_queries
from orebody.symbols import resolve


@pytest.mark.parametrize("name", sorted(git_queries.QUERIES))
def test_query_equals_what_git_says(spark, name):
    got, want = git_queries.QUERIES[name](spark, ""), duckdb.sql(git_queries.oracles()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda row: tuple((v is not None, v) for v in row)
    rows = sorted(map(tuple, got.select(*cols).collect()), key=key)
    assert rows and rows == sorted(want.select(*cols).fetchall(), key=key)


def test_jsonc_and_alias_rules():
    text = '{ // c "x"\n "compilerOptions": {"baseUrl": "src", "paths": {"@a/*": ["./l/*", "../m/*"], "b": ["x//y"], "none": [], "url": ["http://z/*",]} /* ,} */ , }, }'
    assert resolve.read_jsonc('{"a": "// no, ] /* comment */", /* b */ "c": [1, 2, ], }') == {"a": "// no, ] /* comment */", "c": [1, 2]}
    assert resolve.read_jsonc("{") is None and resolve.alias_rules("tsconfig.json", "[]") == [] and resolve.alias_rules("t.json", "not json") == []
    got = {r["prefix"]: (r["folder"], r["open"], r["places"]) for r in resolve.alias_rules("web/tsconfig.json", text)}
    assert got == {"@a/": ("web", True, ["web/src/l", "web/m"]), "b": ("web", False, ["web/src/x/y"]), "url": ("web", False, ["web/src/http:/z"])}


def test_deepest_configuration_decides(spark):
    paths = spark.createDataFrame([(p,) for p in ("a/x.ts", "a/b/x.ts", "x.ts", "lib/x.ts")], "path string")
    rules = spark.createDataFrame([("", 0, "tsconfig.json", "@/", True, ["lib"]), ("a", 0, "a/tsconfig.json", "@/", True, ["a"]), ("a/b", 0, "a/b/tsconfig.json", "@/", True, ["nothing", "a/b"]), ("a", 1, "a/tsconfig.json", "whole", False, ["x"])], "folder string, nth int, config string, prefix string, open boolean, places array<string>")
    uses = spark.createDataFrame([("a/b/u.ts", "@/x"), ("a/u.ts", "@/x"), ("u.ts", "@/x"), ("a/b/u.ts", "whole"), ("ab/u.ts", "@/x"), ("u.ts", "whole"), ("a/u.ts", "@/y")], "path string, module string")
    got = {(r.path, r.module): r.target for r in resolve.resolve_modules(uses, paths, rules).collect()}
    assert got == {("a/b/u.ts", "@/x"): "a/b/x.ts", ("a/u.ts", "@/x"): "a/x.ts", ("u.ts", "@/x"): "lib/x.ts", ("a/b/u.ts", "whole"): "x.ts", ("ab/u.ts", "@/x"): "lib/x.ts"}
