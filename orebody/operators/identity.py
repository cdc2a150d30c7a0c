"""Identity resolution: one person behind several addresses, and suggestions for review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orebody.functions.commits import forge_login, normal_name, token_jaccard
from orebody.storage import components, durable, ranked_ids

# Mailbox names that say nothing about a person.
GENERIC_LOCALS = ["git", "admin", "root", "info", "ci", "noreply", "no-reply", "dev", "hello", "me", "mail", "user", "github", "action", "actions", "bot", "support", "team", "build"]
NAME_BLOCK = 60


def authors_of(observations: DataFrame) -> DataFrame:
    """One row per author_id with the least (name, email) seen; ``observations``: author_id, name, email."""
    return observations.groupBy("author_id").agg(F.min(F.struct("name", "email")).alias("r")).select("author_id", F.col("r.name").alias("name"), F.col("r.email").alias("email"))


def alias_groups(observations: DataFrame, authors: DataFrame) -> DataFrame:
    """(method, confidence, key, author_id): authors who share a key are one person."""
    names = observations.join(authors.select("author_id"), "author_id", "left_semi").select(F.lit("name-exact").alias("method"), F.lit(0.9).alias("confidence"), normal_name(F.col("name")).alias("key"), "author_id")
    logins = authors.select(F.lit("forge-noreply").alias("method"), F.lit(0.95).alias("confidence"), forge_login(F.col("email")).alias("key"), "author_id")
    return names.unionByName(logins).filter("key is not null and key <> ''").distinct()


def resolve(observations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(authors with identity_id, identities, identity_aliases).

    Each group is a star around its least member; the components of all stars
    are the people. An author of a group of two or more has an edge of that
    group's kind, which gives its method (the strongest) and the component's
    confidence (the weakest).
    """
    authors = durable(authors_of(observations), "authors")
    groups = alias_groups(observations, authors)
    least = groups.groupBy("method", "confidence", "key").agg(F.min("author_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    members = durable(groups.join(least, ["method", "confidence", "key"]).select("method", "confidence", "author_id", "first"), "alias")
    roots = components(members.select(F.col("author_id").alias("a"), F.col("first").alias("b")))
    strongest = members.groupBy("author_id").agg(F.max(F.struct("confidence", "method")).alias("e"), F.min("confidence").alias("weakest"))
    placed = authors.join(roots.withColumnRenamed("node", "author_id"), "author_id", "left").withColumn("root", F.coalesce("root", "author_id")).join(strongest, "author_id", "left")
    clusters = placed.groupBy("root").agg(F.min("email").alias("c_email"), F.min("name").alias("c_name"), F.coalesce(F.min("weakest"), F.lit(1.0)).alias("c_confidence"), F.count("*").cast("int").alias("alias_count"))
    numbered = durable(ranked_ids(clusters, ["c_email", "c_name", "root"], "identity_id"), "people")
    linked = placed.join(numbered.select("root", "identity_id"), "root")
    identities = numbered.select("identity_id", F.col("c_name").alias("name"), F.col("c_email").alias("email"), F.col("c_confidence").alias("confidence"), "alias_count")
    aliases = linked.select("identity_id", "author_id", "name", "email", F.coalesce("e.method", F.lit("sole")).alias("method"), F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"))
    return linked.select("author_id", "name", "email", "identity_id"), identities, aliases


def review_queue(identities: DataFrame, aliases: DataFrame, block: int = NAME_BLOCK) -> DataFrame:
    """Pairs that may be one person: similar names inside a first-name block, or a shared mailbox name.

    Blocks above ``block`` names are no candidates by rule; the join works on
    what passes that rule only. Mailbox pairs are kept once, the name reason first.
    """
    named = identities.select("identity_id", "name", normal_name(F.col("name")).alias("norm")).withColumn("first", F.split("norm", " ")[0]).filter("first <> ''")
    calm = named.groupBy("first").agg(F.count("*").alias("n")).filter(F.col("n").between(2, block)).select("first")
    small = named.join(calm, "first", "left_semi")
    a, b = small.alias("a"), small.alias("b")
    sim = token_jaccard(F.col("a.norm"), F.col("b.norm"))
    similar = a.join(b, (F.col("a.first") == F.col("b.first")) & (F.col("a.identity_id") < F.col("b.identity_id"))).select(
        F.col("a.identity_id").alias("identity_a"), F.col("b.identity_id").alias("identity_b"), F.lit(0).alias("rank"), F.lit("name-similar").alias("reason"), sim.alias("similarity")
    )
    similar = similar.filter("similarity >= 0.5 and similarity < 1").withColumn("similarity", F.round("similarity", 3))
    local = F.lower(F.substring_index("email", "@", 1))
    boxes = aliases.filter(F.instr("email", "@") > 0).select(local.alias("local"), "identity_id").filter((F.octet_length("local") >= 3) & ~F.col("local").isin(GENERIC_LOCALS)).distinct()
    x, y = boxes.alias("x"), boxes.alias("y")
    shared = x.join(y, (F.col("x.local") == F.col("y.local")) & (F.col("x.identity_id") < F.col("y.identity_id"))).select(
        F.col("x.identity_id").alias("identity_a"), F.col("y.identity_id").alias("identity_b"), F.lit(1).alias("rank"), F.lit("email-local").alias("reason"), F.lit(0.7).alias("similarity")
    )
    best = similar.unionByName(shared).groupBy("identity_a", "identity_b").agg(F.min(F.struct("rank", "reason", "similarity")).alias("r"))
    for side in ("a", "b"):
        best = best.join(identities.select(F.col("identity_id").alias(f"identity_{side}"), F.col("name").alias(f"name_{side}")), f"identity_{side}")
    return best.select("identity_a", "identity_b", "name_a", "name_b", F.col("r.reason").alias("reason"), F.col("r.similarity").alias("similarity"))


def adjacent_edges(groups: DataFrame) -> DataFrame:
    """Neighbouring members of each group in order: the chain form of the same edges."""
    w = W.partitionBy("method", "key").orderBy("author_id")
    return groups.withColumn("before", F.lag("author_id").over(w)).filter("before is not null").select("method", "confidence", F.col("before").alias("a"), F.col("author_id").alias("b"))
