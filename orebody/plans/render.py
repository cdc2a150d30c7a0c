"""Markdown for the surfaces' envelopes."""

from __future__ import annotations

from datetime import UTC, datetime

CONCENTRATED = 0.75

TITLES = {
    "ownership": "Who owns {path}", "reviewers": "Reviewers for {path}", "blast_radius": "Changes together with {path}", "activity": "Activity in {path}", "contributors": "Contributors to {path}",
    "search": "Matches of “{query}”", "graph": "Dependencies around {path}", "dependencies": "Declared dependencies", "risks": "Risks in {path}", "markers": "Markers in {path}",
}


def day(epoch: int | None) -> str:
    return "–" if epoch is None else datetime.fromtimestamp(epoch, UTC).strftime("%Y-%m-%d")


def _cell(name: str, value) -> str:
    if value is None:
        return ""
    if name.endswith("_epoch"):
        return day(value)
    if name == "share":
        return f"{100 * value:.1f} %"
    if isinstance(value, float):
        return f"{value:g}"
    return str(value).replace("|", "\\|").replace("\n", " ")


def render(envelope: dict) -> str:
    """A heading, a table of the rows, and notes on concentration and on rows left out."""
    params = {"path": "the repository", "query": ""} | envelope["params"]
    rows = envelope["rows"]
    out = [f"## {TITLES[envelope['surface']].format(**params)}", ""]
    if not rows:
        return "\n".join([*out, "No rows."])
    names = list(rows[0])
    out.append("| " + " | ".join(n.removesuffix("_epoch").replace("_", " ") for n in names) + " |")
    out.append("|" + "-|" * len(names))
    out += ["| " + " | ".join(_cell(n, r[n]) for n in names) + " |" for r in rows]
    if envelope["surface"] == "ownership" and rows[0]["share"] >= CONCENTRATED:
        out += ["", f"Knowledge is concentrated: {rows[0]['author_name']} holds {100 * rows[0]['share']:.0f} % of the lines."]
    if envelope["truncated"]:
        out += ["", f"Only the first {envelope['row_count']} rows are shown."]
    return "\n".join(out)
