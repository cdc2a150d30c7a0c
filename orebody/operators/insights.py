"""Ranked risk findings over the derived tables. Each rule is a filter and a top-k; their union is ordered by severity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orebody.functions.paths import area_of


@dataclass(frozen=True)
class Rules:
    bus_lines: int = 50
    bus_share: float = 0.90
    area_lines: int = 200
    area_share: float = 0.80
    hotspot: int = 25
    hidden: int = 8
    hub: int = 15
    fragile: int = 15
    top: int = 20


RULES = Rules()
_COLUMNS = ("kind", "severity", "subject", "metric", "detail")


def _percent(share: Column) -> Column:
    return F.round(share * 100).cast("long")


def _top(rows: DataFrame, weight: Column, n: int) -> DataFrame:
    """The n rows of the largest weight, ties by subject (a bounded heap per task, no global sort)."""
    return rows.withColumn("__w", weight).orderBy(F.desc("__w"), "subject").limit(n).select(*_COLUMNS)


def _finding(rows: DataFrame, kind: str, severity: Column | str, subject: Column, metric: Column, detail: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("*", F.lit(kind).alias("kind"), severity.alias("severity"), subject.alias("subject"), metric.cast("double").alias("metric"), detail.alias("detail"))


def authored(rows: DataFrame, non_authored: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        rows = rows.join(non_authored.select(F.col("file_id").alias(k)), k, "left_anti")
    return rows


def _who(rows: DataFrame, identities: DataFrame) -> DataFrame:
    names = identities.select("identity_id", F.col("name").alias("__name"))
    return rows.join(names, "identity_id", "left").withColumn("who", F.coalesce("__name", F.lit("(unknown)")))


def codebase_bus_factor(file_owners: DataFrame, identities: DataFrame, non_authored: DataFrame, rules: Rules = RULES) -> DataFrame:
    rows = authored(file_owners, non_authored, "file_id")
    total = rows.select("file_id", "file_lines").distinct().agg(F.sum("file_lines").alias("total"))
    first = rows.groupBy("identity_id").agg(F.sum("owned_lines").alias("owned")).orderBy(F.desc("owned"), "identity_id").limit(1)
    share = F.col("owned").cast("double") / F.col("total")
    one = _who(first.join(total.filter("total > 0")), identities)  # two one-row sides
    severity = F.when(share >= 0.80, "critical").when(share >= 0.50, "warning").otherwise("info")
    detail = F.format_string("%s owns %d%% of all lines (%d of %d)", "who", _percent(share), "owned", "total")
    return _finding(one, "codebase_bus_factor", severity, F.lit("repository"), share, detail).select(*_COLUMNS)


def bus_factor_risk(file_owners: DataFrame, files: DataFrame, identities: DataFrame, non_authored: DataFrame, rules: Rules = RULES) -> DataFrame:
    rows = authored(file_owners.filter((F.col("file_lines") >= rules.bus_lines) & (F.col("ownership_share") >= rules.bus_share)), non_authored, "file_id")
    rows = _who(rows.join(files, "file_id"), identities)
    detail = F.format_string("%s alone holds %d%% of %s (%d lines)", "who", _percent(F.col("ownership_share")), "path", "file_lines")
    return _top(_finding(rows, "bus_factor_risk", "critical", F.col("path"), F.col("ownership_share"), detail), F.col("file_lines"), rules.top)


def area_key_person(area_owners: DataFrame, identities: DataFrame, rules: Rules = RULES) -> DataFrame:
    rows = _who(area_owners.filter((F.col("area_lines") >= rules.area_lines) & (F.col("ownership_share") >= rules.area_share)), identities)
    detail = F.format_string("%s holds %d%% of folder %s (%d lines)", "who", _percent(F.col("ownership_share")), "area", "area_lines")
    return _top(_finding(rows, "area_key_person", "warning", F.col("area"), F.col("ownership_share"), detail), F.col("area_lines"), rules.top)


def churn(commit_files: DataFrame, non_authored: DataFrame) -> DataFrame:
    return authored(commit_files.groupBy("file_id").agg(F.count("*").alias("changes")), non_authored, "file_id")


def hotspot(commit_files: DataFrame, files: DataFrame, non_authored: DataFrame, rules: Rules = RULES) -> DataFrame:
    rows = churn(commit_files, non_authored).filter(F.col("changes") >= rules.hotspot).join(files, "file_id")
    detail = F.format_string("%s was changed %d times", "path", "changes")
    return _top(_finding(rows, "hotspot", "info", F.col("path"), F.col("changes"), detail), F.col("changes"), rules.top)


def hidden_coupling(coupled: DataFrame, files: DataFrame, non_authored: DataFrame, rules: Rules = RULES) -> DataFrame:
    rows = authored(coupled.filter(F.col("co_changes") >= rules.hidden), non_authored, "file_a_id", "file_b_id")
    for side in ("a", "b"):
        rows = rows.join(files.select(F.col("file_id").alias(f"file_{side}_id"), F.col("path").alias(f"path_{side}")), f"file_{side}_id")
    rows = rows.filter(area_of(F.col("path_a")) != area_of(F.col("path_b")))
    subject = F.concat_ws(" ↔ ", "path_a", "path_b")
    detail = F.format_string("%s and %s were changed together %d times from different folders", "path_a", "path_b", "co_changes")
    return _top(_finding(rows, "hidden_coupling", "info", subject, F.col("co_changes"), detail), F.col("co_changes"), rules.top)


def dependents(deps: DataFrame, non_authored: DataFrame, rules: Rules = RULES) -> DataFrame:
    rows = deps.groupBy(F.col("to_file_id").alias("file_id")).agg(F.count("*").alias("dependents")).filter(F.col("dependents") >= rules.hub)
    return authored(rows, non_authored, "file_id")


def architecture_hub(deps: DataFrame, files: DataFrame, non_authored: DataFrame, rules: Rules = RULES) -> DataFrame:
    rows = dependents(deps, non_authored, rules).join(files, "file_id")
    severity = F.when(F.col("dependents") >= 2 * rules.hub, "warning").otherwise("info")
    detail = F.format_string("%d files depend on %s", "dependents", "path")
    return _top(_finding(rows, "architecture_hub", severity, F.col("path"), F.col("dependents"), detail), F.col("dependents"), rules.top)


def fragile_hub(deps: DataFrame, commit_files: DataFrame, files: DataFrame, non_authored: DataFrame, rules: Rules = RULES) -> DataFrame:
    busy = churn(commit_files, non_authored).filter(F.col("changes") >= rules.fragile)
    rows = dependents(deps, non_authored, rules).join(busy, "file_id").join(files, "file_id")
    product = F.col("dependents") * F.col("changes")
    detail = F.format_string("%s has %d dependents and was changed %d times", "path", "dependents", "changes")
    return _top(_finding(rows, "fragile_hub", "warning", F.col("path"), product, detail), product, rules.top)


def insights(file_owners: DataFrame, area_owners: DataFrame, coupled: DataFrame, commit_files: DataFrame, files: DataFrame, identities: DataFrame, deps: DataFrame, non_authored: DataFrame, rules: Rules = RULES) -> DataFrame:
    """All findings; at most ``top`` rows a rule, so the final order is over a bounded set."""
    parts = [
        codebase_bus_factor(file_owners, identities, non_authored, rules),
        bus_factor_risk(file_owners, files, identities, non_authored, rules),
        area_key_person(area_owners, identities, rules),
        hotspot(commit_files, files, non_authored, rules),
        hidden_coupling(coupled, files, non_authored, rules),
        architecture_hub(deps, files, non_authored, rules),
        fragile_hub(deps, commit_files, files, non_authored, rules),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return out.orderBy(rank, F.desc("metric"), "kind", "subject")


def dominant_owner(lines: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key by ``order``."""
    return lines.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")
