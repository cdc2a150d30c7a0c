import pytest
from pyspark.sql import functions as F

from orebody.functions import commits as fc
from orebody.functions import content as ft
from orebody.functions import manifests
from orebody.functions import paths as fp
from orebody.schema import SCHEMAS
from orebody.symbols import extract
from orebody.operators import content


def values(spark, kind, items, column):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").select("i", column.alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_schema_shape():
    assert len(SCHEMAS) == 41
    assert not SCHEMAS["commits"]["commit_sha"].nullable and SCHEMAS["commits"]["subject"].nullable


def test_classify(spark):
    cases = {
        "feat(api)!: drop v1": ("feat", "api", True, True), "fix: bug": ("fix", "", True, False), "Fix the bug": ("fix", "", False, False), "Added tests": ("feat", "", False, False),
        "wip: thing": ("other", "", False, False), "refactor(a(b)): x": ("refactor", "a(b)", True, False), "bump deps": ("chore", "", False, False), "#12 fix": ("other", "", False, False),
        "DOCS: x": ("docs", "", True, False), "": ("other", "", False, False), "update!: x": ("other", "", False, False),
        "feat!!: x": ("feat", "", False, False), "feat( core ): x": ("feat", "core", True, False), "feat(x) !: y": ("feat", "x", True, True), "  fixed it": ("fix", "", False, False), "\tperf : x": ("perf", "", True, False),
    }
    got = values(spark, "string", list(cases), fc.classify(F.col("x"), F.lit(False)))
    assert [tuple(g) for g in got] == list(cases.values())
    assert tuple(values(spark, "string", ["feat: x"], fc.classify(F.col("x"), F.lit(True)))[0]) == ("merge", "", False, False)


def test_trailers(spark):
    cases = {
        "S\n\nBody\n\nSigned-off-by: A <a@x>\nReviewed-by: B": [("Signed-off-by", "A <a@x>"), ("Reviewed-by", "B")], "Signed-off-by: A": [], "S\n\njust prose here": [],
        "S\n\nKey: one\n two\n(cherry picked from commit 12)\n": [("Key", "one two")], "S\n\nA: 1\nprose": [], "S\n\nFixes#12": [("Fixes", "12")], "": [], "S\n\n continued": [],
    }
    got = values(spark, "string", list(cases), fc.parse_trailers("x"))
    assert [[(r["key"], r["value"]) for r in g] for g in got] == list(cases.values())


def test_people(spark):
    assert values(spark, "string", ["12+Al-x@users.noreply.github.com", "bob@users.noreply.github.com", "a@x.com"], fc.forge_login(F.col("x"))) == ["al-x", "bob", None]
    assert values(spark, "string", ["renovate[bot]", "Renovate", "GitHub Actions", "Ann"], fc.is_bot(F.col("x"), F.lit("a@x"))) == [True, True, True, False]
    assert values(spark, "string", ["  A \t B "], fc.normal_name(F.col("x"))) == ["a b"]


def test_generated_paths(spark):
    cases = {
        "web/node_modules/x.js": ("vendored", "vendored-dir"), "vendor/a.go": ("vendored", "vendored-dir"), "third_party/yarn.lock": ("vendored", "vendored-dir"), "go/Godeps/x": ("vendored", "vendored-dir"), "a/yarn.lock": ("generated", "lockfile"), "go.sum": ("generated", "lockfile"),
        "x.min.js": ("generated", "minified"), "x.css.map": ("generated", "sourcemap"), "t/x.snap": ("generated", "snapshot"), "a_pb2.py": ("generated", "protobuf"), "x.pb.go": ("generated", "protobuf"), "a.generated.ts": ("generated", "codegen-name"), "a.g.cs": ("generated", "codegen-name"),
        "src/vendors.ts": None, "lock.go": None, "mapper.ts": None, "src/min.js": None, "generated/a.ts": None,
    }
    got = values(spark, "string", list(cases), fp.generated_reason(F.col("x")))
    assert [tuple(g) if g else None for g in got] == list(cases.values())


def test_test_paths(spark):
    cases = {
        "a/b.test.ts": ("ts", "*.test/spec.*"), "b.spec.jsx": ("js", "*.test/spec.*"), "test_a.py": ("py", "test_*/_test.py"), "conftest.py": ("py", "test_*/_test.py"), "a_test.go": ("go", "*_test.go"), "FooTest.java": ("java", "*Test/Tests/Spec"),
        "x_spec.rb": ("rb", "*_spec/_test.rb"), "FooTest.php": ("php", "*Test.php"), "tests/common.rs": ("rust", "dir:test"), "src/main.rs": None, "test/readme.md": None, "contest.py": None,
    }
    rows = fp.with_test_signal(spark.createDataFrame([(p,) for p in cases], "path string")).filter("signal is not null").collect()
    assert {r.path: (r.lang, r.signal) for r in rows} == {p: c for p, c in cases.items() if c}
    stems = {"foo.test": "foo", "test_utils": "utils", "FooTests": "Foo", "bar_spec": "bar", "Test": "Test", "plain": "plain"}
    assert values(spark, "string", list(stems), fp.target_stem(F.col("x"))) == list(stems.values())


def test_markers(spark):
    lines = ["// TODO: a", "TODO_x", "TODOS", "xTODO", "(FIXME) and XXX", "todo", "éTODOé"]
    assert [len(h) for h in values(spark, "string", lines, ft.marker_hits(F.col("x")))] == [1, 1, 0, 0, 2, 0, 1]
    texts = spark.createDataFrame([(1, "// TODO: y\t \nHACK XXX:a TODO"), (2, "none")], "k int, text string")
    assert sorted(map(tuple, content.markers(texts, ["k"]).collect())) == [(1, 1, "TODO", "y"), (1, 2, "HACK", "XXX:a TODO"), (1, 2, "TODO", ""), (1, 2, "XXX", "a TODO")]


def test_subjects(spark):
    assert values(spark, "string", ["a b\r\n\r\nbody", "\t x \n", None], fc.subject_of(F.col("x"))) == ["a b", "x", ""]


def test_line_counts_and_binary(spark):
    assert values(spark, "string", ["", "a", "a\n", "a\r\nb", "\n\n"], ft.line_count(F.col("x"))) == [0, 1, 1, 2, 2]
    assert values(spark, "binary", [b"a\0b", b"ab", b"", b"x" * 8000 + b"\0", bytes(range(1, 256))], ft.is_binary(F.col("x"))) == [True, False, False, False, False]


def test_generated_header(spark):
    cases = {"// Code generated by x. DO NOT EDIT.\n": True, "/* @generated */": True, "# -*- x -*-\n# AUTOGENERATED": True, "This is not @generated": False, "\n" * 15 + "@generated": False, "say: auto-generated": False, "<!-- automatically generated -->": True}
    assert values(spark, "string", list(cases), ft.has_generated_header(F.col("x"))) == list(cases.values())


MANIFESTS = {
    ("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}, "peerDependencies": {"c": "3"}, "optionalDependencies": {"d": {}}}'): [("npm", "a", "1", "runtime"), ("npm", "b", "2", "dev"), ("npm", "c", "3", "peer"), ("npm", "d", "", "optional")],
    ("x/Cargo.toml", '[dependencies]\na = "1"\nb = { version = "2" }\nc = { workspace = true }\nd = { path = "../d" }\n[build-dependencies]\ne = "3"'): [("cargo", "a", "1", "runtime"), ("cargo", "b", "2", "runtime"), ("cargo", "c", "workspace", "runtime"), ("cargo", "d", "", "runtime"), ("cargo", "e", "3", "build")],
    ("pyproject.toml", '[project]\ndependencies = ["a>=1", "b[x]==2; python_version<\'3\'"]\n[project.optional-dependencies]\nt = ["c"]\n[tool.poetry.dependencies]\npython = "3"\nd = "^1"\n[tool.poetry.group.docs.dependencies]\ne = {version = "2"}'): [("pypi", "a", ">=1", "runtime"), ("pypi", "b", "==2", "runtime"), ("pypi", "c", "", "optional"), ("pypi", "d", "^1", "runtime"), ("pypi", "e", "2", "docs")],
    ("requirements.txt", "a==1 # note\n-r other\ngit+https://x\nhttp://y/z\n\nb[extra] >= 2 ; x\n"): [("pypi", "a", "==1", "runtime"), ("pypi", "b", ">= 2", "runtime")],
    ("go.mod", "module m\nrequire x.y/a v1\nrequire (\n\tx.y/b v2 // indirect\n\tx.y/c v3\n)\nx y\n"): [("go", "x.y/a", "v1", "runtime"), ("go", "x.y/b", "v2", "indirect"), ("go", "x.y/c", "v3", "runtime")],
    ("package.json", "{broken"): [],
    ("other.json", "{}"): [],
}


@pytest.mark.parametrize("case", list(MANIFESTS), ids=lambda c: c[0] + str(len(c[1])))
def test_manifests(case):
    assert manifests.declared(case[0], case[1].encode()) == MANIFESTS[case]


SNIPPETS = {
    ("go", "package a\n\ntype Box struct {\n\tN int\n}\n\nfunc (b *Box) Get() int {\n\treturn helper(b.N)\n}\n\nfunc helper(n int) int { return fmt.Sprint(n) }\n"): ({("Box", "type"), ("Get", "method"), ("helper", "function")}, {("helper", "call"), ("Sprint", "method")}),
    ("ruby", "class Foo\n  def bar(x)\n    baz(x)\n    x.qux\n  end\nend\n"): ({("Foo", "class"), ("bar", "method")}, {("baz", "method"), ("qux", "method")}),
    ("c", "#define MAX 3\nstruct box { int n; };\nstatic int helper(int n) {\n  return n;\n}\nint main(void) {\n  return helper(MAX);\n}\n"): ({("MAX", "macro"), ("box", "struct"), ("helper", "function"), ("main", "function")}, {("helper", "call")}),
    ("java", "package a.b;\nimport c.d.Box;\npublic class Foo {\n  private Box box;\n  public Foo() { init(); }\n  int run(String s) {\n    box.get();\n    return new Box().size();\n  }\n}\n"): ({("Foo", "class"), ("Foo", "constructor"), ("run", "method")}, {("init", "method"), ("get", "method"), ("Box", "new"), ("size", "method")}),
    ("csharp", "namespace A.B;\npublic class Foo {\n  public int N { get; set; }\n  public void Run() {\n    Helper.Go();\n    Local();\n    var b = new Box();\n  }\n}\n"): ({("Foo", "class"), ("N", "property"), ("Run", "method")}, {("Go", "method"), ("Local", "call"), ("Box", "new")}),
    ("rust", "use crate::x::Thing;\nstruct Box { n: i32 }\nimpl Box {\n  fn get(&self) -> i32 { helper(self.n) }\n}\nfn helper(n: i32) -> i32 { println!(\"{}\", n); Thing::make(n) }\n"): ({("Box", "struct"), ("get", "function"), ("helper", "function")}, {("helper", "call"), ("println", "macro"), ("make", "call")}),
    ("ts", "export class Foo {\n  run(a: Bar): void {\n    a.go();\n    this.stop();\n  }\n  stop() {}\n}\ninterface Bar { go(): void }\nconst f = (x: number) => new Foo();\nf(1);\n"): ({("Foo", "class"), ("run", "method"), ("stop", "method"), ("Bar", "interface"), ("f", "function")}, {("go", "method"), ("stop", "method"), ("Foo", "new"), ("f", "call")}),
    ("python", "class A:\n    def m(self):\n        return self.n() + g()\n\n\ndef g():\n    pass\n"): ({("A", "class"), ("m", "function"), ("g", "function")}, {("n", "method"), ("g", "call")}),
}


@pytest.mark.parametrize("case", list(SNIPPETS), ids=lambda c: c[0])
def test_symbols(case):
    found = extract.extract(*case)
    symbols, refs = SNIPPETS[case]
    assert {s[:2] for s in found.symbols} == symbols
    assert refs <= {r[:2] for r in found.refs}
    assert all(1 <= a <= b <= case[1].count("\n") + 1 for _, _, a, b in found.symbols)


def test_receivers():
    found = extract.extract("ts", "class Foo {\n  run(a: Bar) {\n    a.go();\n    this.stop();\n  }\n}\n")
    assert {(r[0], r[3]) for r in found.refs} == {("go", "Bar"), ("stop", "Foo")}
    found = extract.extract("java", "class Foo {\n  void run(Bar b) {\n    b.go();\n    stop();\n  }\n}\n")
    assert {(r[0], r[3]) for r in found.refs} == {("go", "Bar"), ("stop", "Foo")}


def test_scopes():
    java = extract.extract("java", "package a.b;\nimport c.d.Box;\nclass X {}\n")
    assert extract.scopes_of("java", "X.java", java) == ("a.b", ["a.b", "c.d"])
    rust = extract.extract("rust", "use super::x::Thing;\n")
    assert extract.scopes_of("rust", "src/a/b.rs", rust) == ("crate::a::b", ["crate::a::b", "crate::a::x"])
    py = extract.extract("python", "from .util import x\nimport a.b\n")
    own, seen = extract.scopes_of("python", "pkg/mod.py", py)
    assert own == "pkg.mod" and {"pkg.util", "a.b"} <= set(seen)
