"""Definitions, references and scopes of one source text.

Python is parsed by its own grammar; the other languages by a lexer that blanks
comments and strings and matches braces. That is an approximation of a full
parser: it sees declarations and calls by their shape.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from dataclasses import dataclass, field

# Language tags by file extension.
LANGS = {
    "ts": "ts", "cts": "ts", "mts": "ts", "tsx": "tsx", "jsx": "tsx", "js": "tsx", "mjs": "tsx", "cjs": "tsx", "rs": "rust", "py": "python", "pyi": "python",
    "go": "go", "java": "java", "cs": "csharp", "rb": "ruby", "c": "c", "h": "c",
}
TYPE_KINDS = ("class", "interface", "struct", "enum", "trait", "record", "union")
NO_CALL = set("if for while switch catch return sizeof typeof await function def elsif unless until match with assert super this self lock using foreach when in not and or new func fn yield throw else do case defined import export require instanceof delete void".split())


@dataclass
class Found:
    symbols: list[tuple[str, str, int, int]] = field(default_factory=list)  # name, kind, first and last line
    refs: list[tuple[str, str, int, str | None, str | None]] = field(default_factory=list)  # name, kind, line, receiver's type, qualifier
    imports: list[tuple[str, str, str]] = field(default_factory=list)  # local name, module, imported name
    reexports: list[tuple[str, str, str]] = field(default_factory=list)  # exported name (* for all), module, original name
    scope: str = ""
    visible: list[str] = field(default_factory=list)
    owners: list[tuple[str, str]] = field(default_factory=list)  # type, method


def language(path: str) -> str | None:
    return LANGS.get(path.rpartition("/")[2].rpartition(".")[2]) if "." in path.rpartition("/")[2] else None


def blank(text: str, lang: str) -> str:
    """Comments and string contents as spaces, line feeds kept."""
    hash_comment = lang in ("ruby",)
    pattern = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    if lang == "rust":
        pattern = r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\''
    if lang in ("ts", "tsx", "go"):
        pattern += r"|`(?:\\.|[^`\\])*`"
    comment = r"#[^\n]*|^=begin.*?^=end" if hash_comment else r"//[^\n]*|/\*.*?\*/"
    keep = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(f"{comment}|{pattern}", keep, text, flags=re.DOTALL | re.MULTILINE)


class Lines:
    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def at(self, pos: int) -> int:
        return bisect_right(self.starts, pos)


def _closing(text: str, start: int) -> int:
    """Place of the brace that closes the one at or after ``start``; of a ``;`` before any brace."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(text, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif depth == 0:
            return m.start()
    return len(text) - 1


_W = r"[A-Za-z_$][\w$]*"
#: lang -> [(pattern with group n for the name, kind, body in braces)]
RULES: dict[str, list[tuple[str, str]]] = {
    "ts": [
        (rf"\bfunction\s*\*?\s*(?P<n>{_W})", "function"), (rf"\b(?:abstract\s+)?class\s+(?P<n>{_W})", "class"), (rf"\binterface\s+(?P<n>{_W})\s*(?:<[^>{{]*>)?\s*(?:extends[^{{]*)?\{{", "interface"),
        (rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+(?P<n>{_W})[^=\n]*=", "type"), (rf"\benum\s+(?P<n>{_W})\s*\{{", "enum"),
        (rf"\b(?:const|let|var)\s+(?P<n>{_W})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()\n]*(?:\([^()]*\)[^()\n]*)*\)\s*(?::\s*[^={{\n]+)?=>|{_W}\s*=>)", "function"),
        (rf"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?(?P<n>#?{_W})\s*(?:<[^>(]*>)?\([^;{{}}]*\)\s*(?::\s*[^{{;=]+)?\{{", "method"),
    ],
    "rust": [(rf"\bfn\s+(?P<n>{_W})", "function"), (rf"\bstruct\s+(?P<n>{_W})", "struct"), (rf"\benum\s+(?P<n>{_W})", "enum"), (rf"\bunion\s+(?P<n>{_W})\s*\{{", "union"), (rf"\btrait\s+(?P<n>{_W})", "trait"), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<n>{_W})", "type"), (rf"\bconst\s+(?P<n>{_W})\s*:", "const"), (rf"\bstatic\s+(?:mut\s+)?(?P<n>{_W})\s*:", "static"), (rf"\bmod\s+(?P<n>{_W})", "module"), (rf"\bmacro_rules!\s*(?P<n>{_W})", "macro")],
    "go": [(rf"^func\s+(?P<n>{_W})\s*[\[(]", "function"), (rf"^func\s+\([^)]*\)\s*(?P<n>{_W})\s*\(", "method"), (rf"^(?:type\s+|\t)(?P<n>{_W})(?:\[[^\]]*\])?\s+(?:struct|interface)\s*\{{", "type"), (rf"^type\s+(?P<n>{_W})(?:\[[^\]]*\])?\s+(?!struct|interface)=?\s*[\w\[\]*.(]", "type"), (rf"^const\s+(?P<n>{_W})\b", "const")],
    "java": [(rf"\bclass\s+(?P<n>{_W})", "class"), (rf"(?<!@)\binterface\s+(?P<n>{_W})", "interface"), (rf"\benum\s+(?P<n>{_W})", "enum"), (rf"\brecord\s+(?P<n>{_W})\s*[(<]", "record"), (rf"^\s*(?:public|private|protected)\s+(?P<n>[A-Z]\w*)\s*\([^;{{}}]*\)\s*(?:throws[^{{]+)?\{{", "constructor"), (rf"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s*)?(?!return\b|new\b|else\b|throw\b)[\w.$]+(?:<[^;{{}}()]*>)?(?:\[\])*\s+(?P<n>{_W})\s*\([^;{{}}]*\)\s*(?:throws[^{{;]+)?[{{;]", "method")],
    "csharp": [(r"^\s*(?:public|private|protected|internal|static)\s+(?P<n>[A-Z]\w*)\s*\([^;{}]*\)\s*(?::[^{]+)?\{", "constructor"), (rf"\bclass\s+(?P<n>{_W})", "class"), (rf"\binterface\s+(?P<n>{_W})", "interface"), (rf"\bstruct\s+(?P<n>{_W})", "struct"), (rf"\benum\s+(?P<n>{_W})", "enum"), (rf"\brecord\s+(?:struct\s+|class\s+)?(?P<n>{_W})\s*[({{;:<]", "record"), (rf"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|partial|extern|new)\s+)+(?!class\b|struct\b|record\b|enum\b|interface\b)[\w.]+(?:<[^;{{}}()]*>)?[\[\]?]*\s+(?P<n>{_W})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?:where[^{{]+)?(?:\{{|=>|;)", "method"), (rf"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|required)\s+)+(?!class\b|struct\b|record\b|enum\b|interface\b)[\w.]+(?:<[^;{{}}()]*>)?[\[\]?]*\s+(?P<n>{_W})\s*(?:\{{\s*(?:get|set|init)|=>)", "property")],
    "c": [(rf"^(?!typedef\b|return\b|else\b)(?:[A-Za-z_][\w\s*]*?[\s*])(?P<n>{_W})\s*\([^;{{}}]*\)\s*\{{", "function"), (rf"\bstruct\s+(?P<n>{_W})\s*\{{", "struct"), (rf"\bunion\s+(?P<n>{_W})\s*\{{", "union"), (rf"\benum\s+(?P<n>{_W})\s*\{{", "enum"), (rf"^typedef\b[^;{{]*(?:\{{[^}}]*\}})?[^;]*?\b(?P<n>{_W})\s*;", "type"), (rf"^\s*#\s*define\s+(?P<n>{_W})", "macro")],
}
RULES["tsx"] = RULES["ts"]

_CALL = re.compile(rf"(?P<new>\bnew\s+)?(?P<q>(?:{_W}\s*(?:\?\.|\.|::|->)\s*)*)(?P<n>{_W})(?P<bang>!)?\s*(?:<[\w\s,.\[\]]*>)?(?:::<[^>]*>)?\(")

_MADE = re.compile(rf"\bnew\s+({_W})\s*\([^()]*\)\s*\.\s*$")


def braces(text: str, lang: str) -> Found:
    """Symbols and references of a language with braces."""
    out, clean = Found(), blank(text, lang)
    lines = Lines(text)
    spans: dict[tuple[str, int], tuple[str, str, int, int]] = {}
    names_at = set()
    for pattern, kind in RULES[lang]:
        for m in re.finditer(pattern, clean, re.MULTILINE):
            name, at = m["n"], m.start("n")
            if name in NO_CALL or (name, at) in spans:
                continue
            last = at if kind == "macro" and lang == "c" else _closing(clean, m.end() - 1 if clean[m.end() - 1] in "{;" else m.end())
            if kind in ("type", "const", "static") and clean[m.end() - 1] != "{":
                last = min(x for x in (clean.find(";", at), clean.find("\n", at), len(clean)) if x >= 0) if lang != "c" else at
            first = lines.at(at)
            spans[name, at] = (name, kind, first, max(first, lines.at(min(last, len(clean) - 1))))
            names_at.add(at)
    out.symbols = sorted(set(spans.values()), key=lambda s: (s[2], s[3], s[0], s[1]))
    types = [s for s in out.symbols if s[1] in TYPE_KINDS]
    impls = []
    if lang == "rust":
        impls = [(m["t"], lines.at(m.start()), lines.at(_closing(clean, m.end() - 1))) for m in re.finditer(rf"\bimpl\b(?:<[^>]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?(?P<t>{_W})[^{{;]*\{{", clean)]
    if lang == "go":
        impls = [(m["t"], lines.at(m.start()), lines.at(_closing(clean, m.end() - 1))) for m in re.finditer(rf"^func\s+\(\s*(?:{_W}\s+)?\*?(?P<t>{_W})(?:\[[^\]]*\])?\s*\)\s*{_W}\s*\(", clean, re.MULTILINE)]

    def enclosing(line: int) -> str | None:
        held = [(b - a, n) for n, a, b in impls if a <= line <= b] or [(s[3] - s[2], s[0]) for s in types if s[2] <= line <= s[3]]
        return min(held)[1] if held else None

    for name, kind, first, _ in out.symbols:
        if kind in ("method", "function", "constructor", "property") and (owner := enclosing(first)):
            out.owners.append((owner, name))
    typed = variable_types(clean, lang)
    for m in _CALL.finditer(clean):
        name = m["n"]
        if m.start("n") in names_at or name in NO_CALL:
            continue
        path = [p for p in re.split(r"\s*(?:\?\.|\.|::|->)\s*", m["q"]) if p]
        line = lines.at(m.start("n"))
        if m["bang"]:
            kind = "macro"
        elif m["new"]:
            kind = "new"
        elif lang == "c":
            kind = "call"
        elif lang == "java" or (path and not (lang == "rust" and "::" in m["q"])):
            kind = "method"
        else:
            kind = "call"
        before = path[-1] if path else None
        receiver = None
        if not path and not m["new"] and clean[max(0, m.start("n") - 80) : m.start("n")].rstrip().endswith("."):
            kind = "method" if lang != "c" else "call"
            made = _MADE.search(clean[max(0, m.start("n") - 160) : m.start("n")])
            receiver, before = (made[1] if made else None), ""
        if kind == "method" and receiver is None and before != "":
            if before in ("this", "self") and len(path) == 1 or lang == "java" and not path:
                receiver = enclosing(line)
            elif before and len(path) <= 2:
                receiver = typed.get(before)
        out.refs.append((name, kind, line, receiver, before or None if kind != "macro" else None))
    if lang == "rust":
        for m in re.finditer(rf"\b(?P<n>{_W})!\s*[\[{{]", clean):
            if m["n"] != "macro_rules":
                out.refs.append((m["n"], "macro", lines.at(m.start()), None, None))
    scopes(out, text, clean, lang)
    return out


def variable_types(clean: str, lang: str) -> dict[str, str]:
    """Types of variables, parameters and fields that a declaration names; a name with two types has none."""
    found: dict[str, set[str]] = {}
    patterns = {
        "ts": [rf"(?P<v>{_W})\s*\??:\s*(?P<t>[A-Z]\w*)\b", rf"(?P<v>{_W})\s*=\s*new\s+(?P<t>{_W})\b"],
        "java": [rf"\b(?P<t>[A-Z]\w*)(?:<[^;(){{}}]*>)?\s+(?P<v>{_W})\s*[=;,)]", rf"\bvar\s+(?P<v>{_W})\s*=\s*new\s+(?P<t>{_W})"],
        "csharp": [rf"\b(?P<t>[A-Z]\w*)(?:<[^;(){{}}]*>)?\??\s+(?P<v>{_W})\s*[=;,)]", rf"\bvar\s+(?P<v>{_W})\s*=\s*new\s+(?P<t>{_W})"],
        "rust": [rf"(?P<v>{_W})\s*:\s*&?\s*(?:'\w+\s+)?(?:mut\s+)?(?P<t>[A-Z]\w*)\b", rf"\blet\s+(?:mut\s+)?(?P<v>{_W})\s*=\s*(?P<t>[A-Z]\w*)(?:::|\s*\{{)"],
        "go": [rf"\b(?P<v>{_W})\s+\*?(?P<t>[A-Z]\w*)\s*[,)\n]", rf"\b(?P<v>{_W})\s*:?=\s*&?(?P<t>[A-Z]\w*)\{{", rf"\bvar\s+(?P<v>{_W})\s+\*?(?P<t>[A-Z]\w*)"],
    }
    for p in patterns.get("ts" if lang == "tsx" else lang, []):
        for m in re.finditer(p, clean):
            found.setdefault(m["v"], set()).add(m["t"])
    return {v: next(iter(t)) for v, t in found.items() if len(t) == 1}


def scopes(out: Found, text: str, clean: str, lang: str) -> None:
    """The text's own scope, the scopes it sees, imports and re-exports."""
    if lang == "java":
        out.scope = next((m[1] for m in re.finditer(r"^\s*package\s+([\w.]+)\s*;", clean, re.MULTILINE)), "")
        out.visible = [out.scope, *(re.sub(r"\.(\*|[A-Z]\w*)$", "", m[1]) for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", clean, re.MULTILINE))]
    elif lang == "csharp":
        out.scope = next((m[1] for m in re.finditer(r"^\s*namespace\s+([\w.]+)", clean, re.MULTILINE)), "")
        out.visible = [out.scope, *(m[1] for m in re.finditer(r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", clean, re.MULTILINE))]
    elif lang == "rust":
        out.visible = [re.sub(r"::(\{.*|\*|[A-Za-z_]\w*)$", "", m[1].strip(), flags=re.DOTALL) for m in re.finditer(r"\buse\s+([^;]+);", clean)]
    elif lang == "go":
        out.scope = next((m[1] for m in re.finditer(r"^package\s+(\w+)", clean, re.MULTILINE)), "")
        for m in re.finditer(r'(?m)^(?:import\s+|\t)(?:(?P<a>[\w.]+)\s+)?"(?P<p>[\w./-]+)"', text):
            out.imports.append((m["a"] or m["p"].rpartition("/")[2], m["p"], "*"))
    elif lang in ("ts", "tsx"):
        for m in re.finditer(r"\bimport\s+(?:type\s+)?(?P<what>[^'\";]*?)\s*from\s*['\"](?P<m>[^'\"]+)['\"]", text):
            what = m["what"]
            if star := re.search(rf"\*\s*as\s+({_W})", what):
                out.imports.append((star[1], m["m"], "*"))
            for name, _, alias in (re.match(rf"\s*(?:type\s+)?({_W})(\s+as\s+({_W}))?", x).groups() for x in re.sub(r".*\{|\}.*", "", what, flags=re.DOTALL).split(",") if "{" in what and re.match(rf"\s*(?:type\s+)?{_W}", x)):
                out.imports.append((alias or name, m["m"], name))
            if default := re.match(rf"\s*({_W})\s*(?:,|$)", what):
                out.imports.append((default[1], m["m"], "default"))
        for m in re.finditer(r"\bexport\s+(?:type\s+)?(?:\*|\{(?P<w>[^}]*)\})\s*from\s*['\"](?P<m>[^'\"]+)['\"]", text):
            if m["w"] is None:
                out.reexports.append(("*", m["m"], "*"))
            for part in (m["w"] or "").split(","):
                if got := re.match(rf"\s*(?:type\s+)?({_W})(?:\s+as\s+({_W}))?", part):
                    out.reexports.append((got[2] or got[1], m["m"], got[1]))


def python(text: str) -> Found:
    out = Found()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out

    def walk(node: ast.AST, owner: str | None, typed: dict[str, str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                out.symbols.append((child.name, "class", child.lineno, child.end_lineno))
                walk(child, child.name, {})
                continue
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                out.symbols.append((child.name, "function", child.lineno, child.end_lineno))
                if owner and isinstance(node, ast.ClassDef):
                    out.owners.append((owner, child.name))
                own = {a.arg: a.annotation.id for a in [*child.args.posonlyargs, *child.args.args, *child.args.kwonlyargs] if isinstance(a.annotation, ast.Name)}
                walk(child, owner, typed | own)
                continue
            if isinstance(child, ast.Assign) and isinstance(child.value, ast.Call) and isinstance(child.value.func, ast.Name) and child.value.func.id[:1].isupper():
                typed.update({t.id: child.value.func.id for t in child.targets if isinstance(t, ast.Name)})
            if isinstance(child, ast.Call):
                f = child.func
                if isinstance(f, ast.Name):
                    out.refs.append((f.id, "call", child.lineno, None, None))
                elif isinstance(f, ast.Attribute):
                    base = f.value.id if isinstance(f.value, ast.Name) else None
                    made = f.value.func.id if isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name) and f.value.func.id[:1].isupper() else None
                    out.refs.append((f.attr, "method", child.lineno, made or (owner if base in ("self", "cls") else typed.get(base or "")), base))
            walk(child, owner, typed)

    walk(tree, None, {})
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out.visible += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out.visible += [("." * n.level) + (n.module or ""), *(("." * n.level) + ".".join(filter(None, [n.module, a.name])) for a in n.names)]
    return out


def ruby(text: str) -> Found:
    out, clean = Found(), blank(text, "ruby")
    rows = clean.split("\n")
    own = set()
    for i, row in enumerate(rows):
        if m := re.match(r"^(\s*)(def|class|module)\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", row):
            end = next((k for k in range(i + 1, len(rows)) if re.match(rf"^{m[1]}end\b", rows[k])), i)
            out.symbols.append((m[3], "method" if m[2] == "def" else m[2], i + 1, end + 1))
            own.add(i)
    for i, row in enumerate(rows):
        for m in re.finditer(r"(?:(\w+)\s*\.\s*)?\b([a-z_]\w*[?!]?)\s*\(|(\w+)\.([a-z_]\w*[?!]?)", row):
            name = m[2] or m[4]
            if name not in NO_CALL and not (i in own and re.match(rf"^\s*def\s+(?:self\.)?{re.escape(name)}", row)):
                out.refs.append((name, "method", i + 1, None, m[1] or m[3]))
    return out


def extract(lang: str, text: str) -> Found:
    return python(text) if lang == "python" else ruby(text) if lang == "ruby" else braces(text, lang)


def python_module(path: str) -> str:
    """Dotted module of a path; only ``.py`` is cut off."""
    parts = path.removesuffix(".py").split("/")
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def rust_module(path: str) -> str:
    """Module path from the crate's source folder on."""
    parts = path.removesuffix(".rs").split("/")
    if "src" in parts:
        parts = parts[len(parts) - parts[::-1].index("src") :]
    if parts and parts[-1] in ("mod", "lib", "main"):
        parts = parts[:-1]
    return "::".join(["crate", *parts])


def scopes_of(lang: str, path: str, found: Found) -> tuple[str, list[str]]:
    """Own scope and visible scopes, with relative ones made absolute."""
    if lang == "python":
        own = python_module(path)
        package = own if path.endswith("__init__.py") else own.rpartition(".")[0]
        seen = []
        for v in found.visible:
            dots = len(v) - len(v.lstrip("."))
            if dots:
                base = package.split(".") if package else []
                base = base[: len(base) - (dots - 1)] if dots > 1 else base
                v = ".".join([*base, *filter(None, [v[dots:]])])
            seen.append(v)
        return own, seen
    if lang == "rust":
        own = rust_module(path)
        up = own.rpartition("::")[0] or "crate"
        return own, [own, *(v.replace("super", up, 1) if v.startswith("super") else v.replace("self", own, 1) if v.startswith("self") else v for v in found.visible)]
    return found.scope, found.visible
