"""Decisions on queued conflicts, applied to one snapshot in the order in which they were made.

A decision that succeeds closes its candidate, and an accepted one takes the place that it writes to; so decisions depend on
earlier ones of the same candidate and of the same place, whoever made them. They are settled in rounds: one that is the
earliest left of both its candidate and its place succeeds, and those that it rules out drop out. The earliest of all is always such a one,
and most others are in the first round.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.discovery import cut

#: The kinds of conflict, each with the relation that an accepted one is written to.
RELATIONS = {"absence-assertion-conflict": "absence", "continuity-conflict": "relation", "instalment-assertion-conflict": "instalment", "title-assertion-conflict": "title"}


class Settled(NamedTuple):
    #: decision_id, candidate_id, outcome (missing, not-open, wrong-kind, collision, rejected or settled)
    outcomes: DataFrame
    #: candidate_id, status, kind: the queue afterwards
    candidates: DataFrame
    #: relation, left_id, right_id, confidence, source: what is to be added
    written: DataFrame


def settle_conflicts(candidates: DataFrame, proposals: DataFrame, decisions: DataFrame, assertions: DataFrame) -> Settled:
    """What each decision comes to, the queue afterwards, and the manual rows that accepted ones write.

    An accepted proposal whose place is taken is a collision, and its candidate stays open; so it does where the proposal is of no
    such kind or number. A title pair is written with the smaller id first; an instalment's counterpart is written beside
    it, where its own place is free. candidates: candidate_id, status, kind; proposals: candidate_id, number (from 0; of kinds but continuity-conflict only
    0), left_id, right_id, confidence, counterpart_id; decisions: decision_id, candidate_id, at, accept, number (null: 0); assertions: relation, left_id, right_id."""
    of_kind = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    relation = F.try_element_at(of_kind, F.col("kind"))
    pair = F.col("kind") == "title-assertion-conflict"
    low, high = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    named = proposals.select("candidate_id", "number", "left_id", "right_id", "confidence", "counterpart_id")
    number = F.when(F.col("kind") == "continuity-conflict", F.coalesce("number", F.lit(0))).otherwise(0)
    asked = decisions.join(candidates, "candidate_id", "left").withColumn("number", number).join(named, ["candidate_id", "number"], "left")
    asked = asked.select(
        "decision_id", "candidate_id", "at", "accept", "status", "kind", relation.alias("relation"), F.when(pair, low).otherwise(F.col("left_id")).alias("left_id"), F.when(pair, high).otherwise(F.col("right_id")).alias("right_id"),
        F.when(F.col("kind") == "continuity-conflict", "high").otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("kind") == "instalment-assertion-conflict", F.col("counterpart_id")).alias("counterpart_id"),
        F.struct("at", "decision_id").alias("turn"),
    )
    place = F.when(F.col("accept"), F.concat_ws("/", "relation", "left_id", "right_id"))
    fits = F.col("relation").isNotNull() & (~F.col("accept") | F.col("left_id").isNotNull())
    taken = assertions.select("relation", "left_id", "right_id").distinct().withColumn("taken", F.lit(True))
    asked = asked.withColumn("place", place).withColumn("fits", fits).join(taken, ["relation", "left_id", "right_id"], "left")
    asked = cut(asked.withColumn("taken", F.col("accept") & F.coalesce("taken", F.lit(False))))
    left = cut(asked.where("status = 'open' AND fits AND NOT taken").select("decision_id", "candidate_id", "turn", "place"))
    won = None
    while left.take(1):
        first = left.groupBy("candidate_id").agg(F.min("turn").alias("turn"))
        ahead = left.where("place IS NOT NULL").groupBy("place").agg(F.min("turn").alias("_first"))
        now = left.join(first, ["candidate_id", "turn"]).join(ahead, "place", "left").where("_first IS NULL OR _first = turn").select("decision_id", "candidate_id", "turn", "place")
        now = cut(now)
        won = now if won is None else won.unionByName(now)
        left = cut(left.join(now.select("candidate_id"), "candidate_id", "left_anti").join(now.where("place IS NOT NULL").select("place"), "place", "left_anti"))
    won = left if won is None else won
    closed = won.select("candidate_id", F.col("turn").alias("_closed"), F.col("decision_id").alias("_by"))
    judged = asked.join(closed, "candidate_id", "left")
    own = F.coalesce(F.col("_by") == F.col("decision_id"), F.lit(False))
    outcome = (
        F.when(F.col("status").isNull(), "missing").when(F.col("status") != "open", "not-open").when(own, F.when(F.col("accept"), "settled").otherwise("rejected"))
        .when(F.coalesce(F.col("_closed") < F.col("turn"), F.lit(False)), "not-open").when(~F.col("fits"), "wrong-kind").otherwise("collision")
    )
    outcomes = cut(judged.withColumn("outcome", outcome))
    verdict = outcomes.where("outcome IN ('settled', 'rejected')").select("candidate_id", F.when(F.col("outcome") == "settled", "accepted").otherwise("rejected").alias("_status"))
    queue = candidates.join(verdict, "candidate_id", "left").select("candidate_id", F.coalesce("_status", "status").alias("status"), "kind")
    settled = outcomes.where("outcome = 'settled'")
    manual = F.lit("manual").alias("source")
    written = settled.select("relation", "left_id", "right_id", "confidence", manual)
    beside = settled.where("counterpart_id IS NOT NULL").groupBy("relation", F.col("counterpart_id").alias("left_id"), "right_id").agg(F.min_by("confidence", "turn").alias("confidence"))
    key = ["relation", "left_id", "right_id"]
    beside = beside.join(taken, key, "left_anti").join(written, key, "left_anti").select(*key, "confidence", manual)
    return Settled(outcomes.select("decision_id", "candidate_id", "outcome"), queue, written.unionByName(beside))
