"""Dependency manifests: path and contents to declared dependencies."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import DataFrame

KINDS = {"package.json": "npm", "Cargo.toml": "cargo", "pyproject.toml": "pyproject", "requirements.txt": "requirements", "go.mod": "gomod"}
NPM = {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"}
CARGO = {"dependencies": "runtime", "dev-dependencies": "dev", "build-dependencies": "build"}

Found = Iterator[tuple[str, str, str, str]]  # ecosystem, name, version, scope


def requirement(spec: str) -> tuple[str, str] | None:
    """Name and version part of a requirement; extras and markers are dropped."""
    m = re.match(r"\s*([A-Za-z0-9._-]+)\s*(.*)", spec, re.DOTALL)
    if not m or spec.strip().startswith("#"):
        return None
    rest = m[2].strip()
    if rest.startswith("["):
        rest = rest.partition("]")[2].strip() if "]" in rest else ""
    return m[1], rest.partition(";")[0].strip()


def _table(value) -> dict:
    return value if isinstance(value, dict) else {}


def _version(spec, workspace: bool = False) -> str:
    if isinstance(spec, str):
        return spec
    if workspace and _table(spec).get("workspace") is True:
        return "workspace"
    version = _table(spec).get("version", "")
    return version if isinstance(version, str) else ""


def npm(text: str) -> Found:
    data = _table(json.loads(text))
    for field, scope in NPM.items():
        for name, version in _table(data.get(field)).items():
            yield "npm", name, version if isinstance(version, str) else "", scope


def cargo(text: str) -> Found:
    data = tomllib.loads(text)
    for field, scope in CARGO.items():
        for name, spec in _table(data.get(field)).items():
            yield "cargo", name, _version(spec, True), scope


def _listed(specs, scope: str) -> Found:
    for spec in specs if isinstance(specs, list) else []:
        if isinstance(spec, str) and (found := requirement(spec)):
            yield "pypi", *found, scope


def pyproject(text: str) -> Found:
    data = tomllib.loads(text)
    project = _table(data.get("project"))
    yield from _listed(project.get("dependencies"), "runtime")
    for specs in _table(project.get("optional-dependencies")).values():
        yield from _listed(specs, "optional")
    poetry = _table(_table(data.get("tool")).get("poetry"))
    scoped = [(poetry.get("dependencies"), "runtime"), (poetry.get("dev-dependencies"), "dev")]
    scoped += [(_table(group).get("dependencies"), name) for name, group in _table(poetry.get("group")).items()]
    for specs, scope in scoped:
        for name, spec in _table(specs).items():
            if name != "python":
                yield "pypi", name, _version(spec), scope


def requirements(text: str) -> Found:
    for raw in text.splitlines():
        line = raw.partition("#")[0].strip()
        if line and not line.startswith(("-", "git+")) and "://" not in line and (found := requirement(line)):
            yield "pypi", *found, "runtime"


def gomod(text: str) -> Found:
    inside = False
    for raw in text.splitlines():
        line = raw.partition("//")[0].strip()
        if line == "require (":
            inside = True
        elif inside and line == ")":
            inside = False
        elif inside or line.startswith("require "):
            parts = line.removeprefix("require ").split()
            if len(parts) >= 2:
                yield "go", parts[0], parts[1], "indirect" if "// indirect" in raw else "runtime"


PARSERS = {"npm": npm, "cargo": cargo, "pyproject": pyproject, "requirements": requirements, "gomod": gomod}


def declared(path: str, raw: bytes) -> list[tuple[str, str, str, str]]:
    """Dependencies of one manifest; a manifest that doesn't parse declares none."""
    kind = KINDS.get(path.rpartition("/")[2])
    if kind is None:
        return []
    try:
        return list(PARSERS[kind](raw.decode("utf-8")))
    except (ValueError, RecursionError):
        return []


def dependencies(blobs: DataFrame) -> DataFrame:
    """Dependencies of all manifests; ``blobs``: path, bytes."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(p, *d) for p, raw in zip(b.column("path").to_pylist(), b.column("bytes").to_pylist(), strict=True) for d in declared(p, raw or b"")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["manifest_path", "ecosystem", "name", "version", "scope"])

    return blobs.select("path", "bytes").mapInArrow(run, "manifest_path string, ecosystem string, name string, version string, scope string")
