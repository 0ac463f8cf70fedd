"""Structural discovery: the titles that name a shared title back, ordered, fetched on one budget, and mapped one after another.

Relations: titles (group_id, ordinal, shared, boundary; null: its instalments can't be listed) and instalments (group_id, ordinal, pos,
locator, kind, air_date, runtime, title) of a group's titles; ordinals are places in the group's order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.discovery import cut, member_order
from tessera.operators.graph import ranked
from tessera.operators.ladder import episode_links, places_of


class Mapped(NamedTuple):
    #: group_id, ordinal (of the member), shared, member (locators), confidence; of mapped groups only
    pairs: DataFrame
    #: group_id, mapped
    groups: DataFrame


class Discovered(NamedTuple):
    #: group_id, ref (of the member), ordinal, shared, member (locators), confidence
    pairs: DataFrame
    #: group_id, outcome, n_members, anchor_ordinal (of discovered groups)
    groups: DataFrame


def map_members(titles: DataFrame, instalments: DataFrame) -> Mapped:
    """Each member of a group matched, in order, against what earlier members left unclaimed of the shared title.

    Round k takes the k-th members of all groups at once, so there are as many rounds as the largest group has members; what is left of a
    shared title is placed anew in each, as a stream of its own. All or nothing: one title that can't be listed, or was cut
    short, voids its group before anything is matched."""
    able = F.coalesce(F.col("boundary") != "truncated", F.lit(False))
    groups = titles.groupBy("group_id").agg(F.bool_and(able).alias("mapped"))
    good = groups.where("mapped").select("group_id")
    members = ranked(titles.where("NOT shared").join(good, "group_id", "left_semi"), ["group_id"], ["ordinal"], "round")
    anchors = titles.where("shared").join(good, "group_id", "left_semi")
    members, anchors = cut(members.select("group_id", "ordinal", "round", "boundary")), cut(anchors.select("group_id", "ordinal", "boundary"))
    columns = ["pos", "locator", "kind", "air_date", "runtime", "title", "boundary"]
    left = anchors.join(instalments, ["group_id", "ordinal"]).select("group_id", *columns)
    pairs = None
    for k in range(1, (members.agg(F.max("round")).first()[0] or 0) + 1):
        now = members.where(F.col("round") == k)
        stream = left.join(now, "group_id", "left_semi").select(F.col("group_id").alias("pair_id"), F.lit("left").alias("side"), *columns)
        stream = stream.unionByName(now.join(instalments, ["group_id", "ordinal"]).select(F.col("group_id").alias("pair_id"), F.lit("right").alias("side"), *columns))
        places = Window.partitionBy("pair_id", "side").orderBy("pos")
        stream = cut(stream.withColumn("pos", F.row_number().over(places) - 1))
        links = episode_links(stream, places_of(stream)).join(now.select(F.col("group_id").alias("pair_id"), "ordinal"), "pair_id")
        links = cut(links.select(F.col("pair_id").alias("group_id"), "ordinal", F.col("left").alias("shared"), F.col("right").alias("member"), F.col("outcome").alias("confidence")))
        pairs = links if pairs is None else pairs.unionByName(links)
        left = left.join(links.select("group_id", F.explode("shared").alias("locator")), ["group_id", "locator"], "left_anti")
    if pairs is None:
        spark = titles.sparkSession
        kind = dict(titles.dtypes)
        pairs = spark.createDataFrame([], f"group_id {kind['group_id']}, ordinal {kind['ordinal']}, shared array<string>, member array<string>, confidence string")
    return Mapped(pairs, groups)


def discover(requests: DataFrame, found: DataFrame, named: DataFrame, titles: DataFrame, instalments: DataFrame) -> Discovered:
    """The group of each shared title: no-group, over-budget, unmappable-member, or discovered with all its members mapped.

    A candidate joins if it names the shared title back. The shared title and every member cost one request each, and the whole
    group must fit its budget. requests: group_id, ref, budget; found: ref, candidate; named: ref, names (another title's ref); titles:
    ref, service, native, first_air_date, boundary (no row or null: can't be listed); instalments: ref, pos, locator, kind, air_date, runtime, title."""
    candidates = requests.join(found, "ref").where("candidate <> ref").select("group_id", "ref", F.col("candidate")).distinct()
    back = named.select(F.col("ref").alias("candidate"), F.col("names").alias("ref")).distinct()
    members = candidates.join(back, ["candidate", "ref"], "left_semi").select("group_id", F.col("candidate").alias("ref"), F.lit(False).alias("shared"))
    groups = members.select("group_id").distinct()
    every = members.unionByName(requests.join(groups, "group_id", "left_semi").select("group_id", "ref", F.lit(True).alias("shared")))
    dated = every.join(titles.withColumn("date", F.expr("try_cast(first_air_date AS date)")), "ref", "left")
    placed = cut(member_order(dated).select("group_id", "ref", (F.col("place") - 1).alias("ordinal"), "shared", "boundary"))
    sizes = placed.groupBy("group_id").agg((F.count("*") - 1).alias("n_members"), F.min(F.when(F.col("shared"), F.col("ordinal"))).alias("anchor_ordinal"))
    sized = requests.join(sizes, "group_id", "left")
    affordable = sized.where("n_members + 1 <= budget").select("group_id")
    fetched = placed.join(affordable, "group_id", "left_semi")
    listed = fetched.join(instalments, "ref").drop("boundary", "shared", "ref")
    mapped = map_members(fetched.select("group_id", "ordinal", "shared", "boundary"), listed)
    outcome = (
        F.when(F.col("n_members").isNull(), "no-group").when(F.col("n_members") + 1 > F.col("budget"), "over-budget").when(F.col("mapped"), "discovered").otherwise("unmappable-member")
    )
    result = sized.join(mapped.groups, "group_id", "left").select("group_id", outcome.alias("outcome"), F.coalesce("n_members", F.lit(0)).alias("n_members"), "anchor_ordinal")
    result = result.withColumn("anchor_ordinal", F.when(F.col("outcome") == "discovered", F.col("anchor_ordinal")))
    pairs = mapped.pairs.join(placed.select("group_id", "ordinal", "ref"), ["group_id", "ordinal"]).select("group_id", "ref", "ordinal", "shared", "member", "confidence")
    return Discovered(pairs, result)
