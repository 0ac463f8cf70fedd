"""State changes as functions from a snapshot and a log of decisions to the next snapshot.

Nothing is updated in place: each function returns the relation as it stands afterwards, for a single writer to save.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scores import source_rank
from tessera.operators.graph import first_of

#: The curated sources.
CURATED = ["llm-research", "llm-verified", "community", "manual"]


def insert_ignore(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, but for keys that are there already; of repeated new keys the first by all columns."""
    fresh = first_of(rows, keys, [c for c in rows.columns if c not in keys] or keys)
    return current.unionByName(fresh.join(current.select(*keys), keys, "left_anti").select(*current.columns))


def upsert(current: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows replace those of the same key; of repeated keys the row with the largest ``order`` stays."""
    both = current.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return first_of(both, keys, [F.desc("_new"), F.desc(order)]).drop("_new")


def recompute(assertions: DataFrame, pairings: DataFrame) -> DataFrame:
    """Assertions after a rebuild: tier links go, curated and bootstrap ones stay, fresh pairings come unless they collide.

    assertions: instalment_id, unit_id, source; pairings: pairing_id, instalment_id, unit_id, source. A pairing that touches a curated
    instalment is dropped whole."""
    curated = assertions.where(F.col("source").isin(CURATED))
    collides = pairings.join(curated.select("instalment_id"), "instalment_id", "left_semi").select("pairing_id").distinct()
    fresh = pairings.join(collides, "pairing_id", "left_anti").select("instalment_id", "unit_id", "source")
    kept = assertions.where(F.col("source").isin(CURATED) | (F.col("source") == "bootstrap"))
    return kept.select("instalment_id", "unit_id", "source").unionByName(fresh)


def corroborate(evidence: DataFrame) -> DataFrame:
    """Confidence of proposals by their evidence: proposal_id, kind (api, site, scrape, wiki), operator, stance, validated.

    A scrape or a contradiction: low; else high with two operators and a validated api. Wikis don't count."""
    counted = evidence.where("kind <> 'wiki'")
    name = F.lower(F.trim("operator"))
    out = counted.groupBy("proposal_id").agg(
        F.bool_or((F.col("kind") == "scrape") | (F.col("stance") == "contradicts")).alias("_bad"),
        F.countDistinct(F.when(name != "", name)).alias("_operators"),
        F.bool_or((F.col("kind") == "api") & F.col("validated")).alias("_api"),
    )
    all_ = evidence.select("proposal_id").distinct().join(out, "proposal_id", "left")
    good = F.coalesce(~F.col("_bad") & (F.col("_operators") >= 2) & F.col("_api"), F.lit(False))
    return all_.select("proposal_id", F.when(good, "high").otherwise("low").alias("confidence"))


def queue(open_: DataFrame, proposals: DataFrame, rejected: DataFrame) -> DataFrame:
    """Proposals to queue: not rejected before, and once per open key. All: kind, subject_key, evidence_hash."""
    keys = ["kind", "subject_key", "evidence_hash"]
    return proposals.select(*keys).distinct().join(rejected.select(*keys), keys, "left_anti").join(open_.select(*keys), keys, "left_anti")


def promote(assertions: DataFrame, verified: DataFrame) -> DataFrame:
    """Researched assertions that were verified become so; others keep their source. verified: assertion_id."""
    hit = verified.select("assertion_id", F.lit(True).alias("_hit")).distinct()
    source = F.when(F.col("_hit") & (F.col("source") == "llm-research"), "llm-verified").otherwise(F.col("source"))
    return assertions.join(hit, "assertion_id", "left").withColumn("source", source).drop("_hit")


def outranking(held: DataFrame, proposals: DataFrame, keys: list[str]) -> DataFrame:
    """Proposals that what is held does not outrank: of another source rank or free keys. Both: keys, source."""
    top = held.groupBy(*keys).agg(F.max(source_rank(F.col("source"))).alias("_held"))
    return proposals.join(top, keys, "left").where(F.col("_held").isNull() | (F.col("_held") <= source_rank(F.col("source")))).drop("_held")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def settle(decisions: DataFrame) -> DataFrame:
    """State of each candidate after its log: only an open one can be decided on, so the first decision stays, of one time
    that with the smallest id; those without stay open. decisions: candidate_id, at, decision_id, verdict."""
    first = F.min_by("verdict", F.when(F.col("verdict").isNotNull(), F.struct("at", "decision_id")))
    return decisions.groupBy("candidate_id").agg(F.coalesce(first, F.lit("open")).alias("status"))
