"""Whole groups: flags on weak research, revalidation, rewriting of continuities.

A group's titles and a continuity's segments are few; windows go over these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.curation import recompute
from tessera.operators.graph import first_of, ranked, spine
from tessera.operators.publication import rechecked, retire_bootstrap

FLAG = "low-confidence-flag"


def low_confidence_flags(instalments: DataFrame, pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Candidates that ask for a review: kind, subject_key, evidence_hash, confidence. ``insert_ignore`` on the first three queues them.

    instalments: title_id, instalment_id, unit_id, confidence; pairs (undirected) and relations (directed): from_id, to_id, confidence. The
    subject of an instalment is its title, that of the others the pair in ascending order."""
    low, high = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
    beside = F.concat(F.lit("title-pair:"), low, F.lit(","), high)
    flag = lambda df, subject, *evidence: df.select(F.lit(FLAG).alias("kind"), subject.alias("subject_key"), F.concat(F.lit(f"{FLAG}:"), *evidence).alias("evidence_hash"), "confidence")
    of_instalments = flag(instalments, F.concat(F.lit("title:"), "title_id"), F.concat_ws(":", F.col("instalment_id").cast("string"), F.col("unit_id").cast("string")))
    of_pairs = flag(pairs, beside, F.lit("title:"), low, F.lit(":"), high)
    return of_instalments.unionByName(of_pairs).unionByName(flag(relations, beside, F.lit("relation:"), "from_id", F.lit("->"), "to_id"))


def revalidate(assertions: DataFrame, pairings: DataFrame, blocked: DataFrame, records: DataFrame, cost: Column, budget: int) -> DataFrame:
    """Assertions of groups after revalidation: rebuilt from fresh pairings, bootstrap scaffolding retired, research rechecked in budget.

    assertions and pairings: group_id, instalment_id, unit_id, source, and pairing_id of pairings, whose instalments are their group's;
    blocked: group_id, where the rebuild may not be applied: such a group stays as it is; records: instalment_id, found (unit). Returned:
    group_id, instalment_id, unit_id, source, verdict (null if not rechecked), confidence (low where the recheck disagrees)."""
    stopped = blocked.select("group_id").distinct()
    columns = ["group_id", "instalment_id", "unit_id", "source"]
    held = assertions.join(stopped, "group_id", "left_semi").select(*columns)
    free, fresh = (df.join(stopped, "group_id", "left_anti") for df in (assertions, pairings))
    owner = free.select("instalment_id", "group_id").unionByName(fresh.select("instalment_id", "group_id")).distinct()
    rebuilt = recompute(free, fresh).join(owner, "instalment_id").select(*columns)
    kept = retire_bootstrap(rebuilt, owner)
    research = ranked(kept.where("source = 'llm-research'").distinct(), ["group_id"], ["instalment_id", "unit_id"], "pos")
    name = F.concat_ws(":", F.col("instalment_id").cast("string"), F.col("unit_id").cast("string"))
    asked = research.select("group_id", name.alias("assertion_id"), "pos", cost.alias("cost"), F.col("unit_id").alias("stated"), F.lit("high").alias("confidence"), "instalment_id")
    found = asked.select("assertion_id", "instalment_id").join(records, "instalment_id").select("assertion_id", "found")
    verdicts = rechecked(asked.drop("instalment_id"), found, budget)
    name = F.when(F.col("source") == "llm-research", name)
    after = kept.withColumn("assertion_id", name).join(verdicts, "assertion_id", "left").drop("assertion_id").withColumn("confidence", F.coalesce("confidence", F.lit("high")))
    return after.unionByName(held.withColumn("verdict", F.lit(None).cast("string")).withColumn("confidence", F.lit("high"))).select(*columns, "verdict", "confidence")


def join_continuities(requests: DataFrame, titles: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments of the continuity that each request leaves: request_id, continuity_id (null: a new one), title_id, pos, added.

    requests: request_id, from_group, to_group, from_title, to_title: a relation from a title to a later one of another group; for a
    group's own continuities to be joined both groups are that group and the titles null. The continuity of the smallest id survives.
    What others hold goes behind it, or before it where it holds titles of the later group and none of the earlier; a title that it
    has already is not repeated. An end whose group is not represented is added, the earlier one before a represented later one.
    Each request is answered from the same snapshot. titles: title_id, group_id; segments: continuity_id, pos, title_id."""
    asked = requests.where("from_title IS NULL OR from_group <> to_group")
    ends = asked.select("request_id", F.explode(F.array("from_group", "to_group")).alias("group_id")).distinct()
    placed = segments.join(titles.select("title_id", "group_id"), "title_id")
    held = ends.join(placed.select("group_id", "continuity_id").distinct(), "group_id").select("request_id", "continuity_id").distinct()
    survivor = held.groupBy("request_id").agg(F.min("continuity_id").alias("survivor"))
    rows = held.join(survivor, "request_id").join(placed, "continuity_id").withColumn("own", F.col("continuity_id") == F.col("survivor"))
    once = first_of(rows, ["request_id", "title_id"], [F.desc("own"), "continuity_id", "pos"])
    has = lambda x, c: F.coalesce(F.bool_or(c & (F.col("group_id") == F.col(x))), F.lit(False))
    full = asked.join(survivor, "request_id", "left")
    state = full.join(once.drop("survivor"), "request_id", "left").groupBy("request_id", "survivor", "from_group", "to_group", "from_title", "to_title").agg(
        has("from_group", F.lit(True)).alias("from_in"), has("to_group", F.lit(True)).alias("to_in"), (has("to_group", F.col("own")) & ~has("from_group", F.col("own"))).alias("before")
    )
    part = F.when(F.col("own"), 1).when(F.col("before"), 0).otherwise(2)
    merged = once.drop("survivor").join(state, "request_id").select("request_id", "survivor", "title_id", part.alias("part"), "continuity_id", "pos", F.lit(False).alias("added"))
    new = lambda end, part: state.where(f"{end}_title IS NOT NULL AND NOT {end}_in").select("request_id", "survivor", F.col(f"{end}_title").alias("title_id"), part.alias("part"), F.lit(None).cast("long").alias("continuity_id"), F.lit(None).cast("long").alias("pos"), F.lit(True).alias("added"))
    every = merged.unionByName(new("from", F.when(F.col("to_in"), -1).otherwise(3))).unionByName(new("to", F.lit(4)))
    return ranked(every, ["request_id"], ["part", "continuity_id", "pos"], "place").select("request_id", F.col("survivor").alias("continuity_id"), "title_id", (F.col("place") - 1).alias("pos"), "added")


def ensure_continuities(groups: DataFrame, titles: DataFrame, segments: DataFrame) -> DataFrame:
    """The continuity of each group: those that hold its titles joined to one, else a new one along its spine; none without a spine.

    groups: group_id; titles: title_id, group_id, service, ordinal, native. Returned as by ``join_continuities``, request_id being the group."""
    asked = groups.select("group_id").distinct()
    own = asked.select(F.col("group_id").alias("request_id"), F.col("group_id").alias("from_group"), F.col("group_id").alias("to_group"), F.lit(None).cast("long").alias("from_title"), F.lit(None).cast("long").alias("to_title"))
    joined = join_continuities(own, titles, segments)
    fresh = spine(titles.join(asked, "group_id", "left_semi")).join(joined.select(F.col("request_id").alias("group_id")).distinct(), "group_id", "left_anti")
    return joined.unionByName(fresh.select(F.col("group_id").alias("request_id"), F.lit(None).cast("long").alias("continuity_id"), "title_id", (F.col("place") - 1).alias("pos"), F.lit(True).alias("added")))
