"""Scalar functions over paths and modes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vendored folders, lockfiles, and endings of generated files by reason.
VENDORED = ["node_modules", "bower_components", "vendor", "vendored", "third_party", "third-party", "Godeps"]
LOCKFILES = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "composer.lock", "go.sum", "flake.lock"]
ENDINGS = {
    "minified": [".min.js", ".min.css"],
    "sourcemap": [".map"],
    "snapshot": [".snap"],
    "protobuf": [".pb.go", ".pb.cc", ".pb.h", "_pb2.py", "_pb2_grpc.py"],
}
CODEGEN = [".g.dart", ".freezed.dart", ".designer.cs", ".g.cs"]
# Languages of test files by extension, and folders that hold tests.
TEST_LANGS = {
    "ts": ["ts", "tsx", "mts", "cts"], "js": ["js", "jsx", "mjs", "cjs"], "py": ["py"], "go": ["go"], "rust": ["rs"], "java": ["java"],
    "kotlin": ["kt", "kts"], "rb": ["rb"], "php": ["php"], "csharp": ["cs"],
}
TEST_DIRS = ["__tests__", "__test__", "tests", "test", "spec", "specs"]


def base_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    """Parent folder; empty at the root."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def area_of(path: Column) -> Column:
    """Parent folder; ``.`` at the root."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(dir_of(path))


def stem_of(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_of(path), r"\.[^.]*$", "")


def extension_of(path: Column) -> Column:
    return F.regexp_extract(base_of(path), r"(?s)\.([^.]*)$", 1)


def _any_end(value: Column, endings: list[str]) -> Column:
    return reduce(lambda a, e: a | value.endswith(e), endings, F.lit(False))


def generated_reason(path: Column) -> Column:
    """struct(category, reason) of generated and vendored paths, else null; the first rule that holds decides."""
    base = base_of(path)
    rule = F.when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDORED))), "vendored-dir").when(base.isin(LOCKFILES), "lockfile")
    for reason, endings in ENDINGS.items():
        rule = rule.when(_any_end(base, endings), reason)
    rule = rule.when(base.contains(".generated.") | _any_end(base, CODEGEN), "codegen-name")
    category = F.when(rule == "vendored-dir", "vendored").otherwise("generated")
    return F.when(rule.isNotNull(), F.struct(category.alias("category"), rule.alias("reason")))


def test_lang(ext: Column) -> Column:
    """Language of a file that may hold tests, by its extension."""
    return reduce(lambda a, kv: a.when(ext.isin(kv[1]), kv[0]), TEST_LANGS.items(), F.when(F.lit(False), ""))


def test_signal(lang: Column, stem: Column, folder: Column) -> Column:
    """What makes a file a test file, else null."""
    return (
        F.when(lang.isin("ts", "js") & _any_end(stem, [".test", ".spec"]), "*.test/spec.*")
        .when((lang == "py") & (stem.startswith("test_") | stem.endswith("_test") | stem.isin("test", "conftest")), "test_*/_test.py")
        .when((lang == "go") & stem.endswith("_test"), "*_test.go")
        .when(lang.isin("java", "kotlin", "csharp") & _any_end(stem, ["Test", "Tests", "Spec"]), "*Test/Tests/Spec")
        .when((lang == "rb") & _any_end(stem, ["_spec", "_test"]), "*_spec/_test.rb")
        .when((lang == "php") & stem.endswith("Test"), "*Test.php")
        .when(lang.isNotNull() & F.arrays_overlap(F.split(folder, "/"), F.array(*map(F.lit, TEST_DIRS))), "dir:test")
    )


def with_test_signal(files: DataFrame) -> DataFrame:
    """``files`` (with path) plus lang, stem, dir and signal; each column is computed once, from the one before it."""
    cut = files.withColumns({"__base": base_of(F.col("path")), "dir": dir_of(F.col("path"))})
    parts = cut.withColumns({"stem": F.regexp_replace("__base", r"\.[^.]*$", ""), "__ext": F.regexp_extract("__base", r"(?s)\.([^.]*)$", 1)})
    named = parts.withColumn("lang", test_lang(F.col("__ext"))).filter("lang is not null")
    return named.withColumn("signal", test_signal(F.col("lang"), F.col("stem"), F.col("dir"))).drop("__base", "__ext")


def target_stem(stem: Column) -> Column:
    """Stem of the file that a test with this stem is about."""
    out = F.when(_any_end(stem, [".test", ".spec", "_test", "_spec"]), F.regexp_replace(stem, r"(\.test|\.spec|_test|_spec)$", ""))
    for tail in ("Tests", "Test", "Spec"):
        out = out.when(stem.endswith(tail) & (F.length(stem) > len(tail)), F.regexp_replace(stem, f"{tail}$", ""))
    return out.when(stem.startswith("test_"), F.regexp_replace(stem, "^test_", "")).otherwise(stem)


def entry_type(mode: Column) -> Column:
    return F.when(mode == "100755", "executable").when(mode == "120000", "symlink").when(mode == "160000", "submodule").when(mode.isin("040000", "40000"), "tree").otherwise("blob")


def ref_kind(name: Column, object_type: Column, is_symbolic: Column) -> Column:
    tag = F.when(object_type == "tag", "tag-annotated").otherwise("tag-lightweight")
    return F.when(is_symbolic, "symbolic").when(name.startswith("refs/heads/"), "branch").when(name.startswith("refs/remotes/"), "remote-branch").when(name.startswith("refs/tags/"), tag).otherwise("other")


def peeled_commit(object_type: Column, object_sha: Column, target_type: Column, target_sha: Column) -> Column:
    """Commit that a ref resolves to; null for tags of trees and blobs."""
    return F.when((target_sha != "") & (target_type == "commit"), target_sha).when(object_type == "commit", object_sha)
