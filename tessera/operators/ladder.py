"""The whole ladder: three tiers one after another on a shared budget, an order that one hands to the next, and the alignment.

Relations: stream (pair_id, side, pos, locator, kind, boundary, air_date, runtime, title); segments (pair_id, side, segment_no, pos,
number, locator, air_date, title); budgets (pair_id, most, t1_cost, list_cost, detail_cost; a pair without a row pays nothing);
orders (pair_id, order_no, segment_no, pos, locator, air_date, title): other orders of the left side that its catalogue lists.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import matcher as m
from tessera.operators.discovery import cut
from tessera.operators.graph import first_of, ranked

#: The tiers, and how many of a catalogue's orders are looked into.
TIERS = ["t1-structure", "t2-pattern", "t3-episode"]
MOST_ORDERS = 3


class Ladder(NamedTuple):
    #: pair_id, tier, left, right (locators), confidence
    links: DataFrame
    #: pair_id, side, locator, place: the order that links are held against
    places: DataFrame
    #: pair_id, tier, kind (proposed or over-budget), n_links, spent
    trace: DataFrame
    #: pair_id, n_strays, n_reused, n_crossings, status
    outcome: DataFrame


class Paid(NamedTuple):
    #: pair_id, left, right, confidence
    links: DataFrame
    #: pair_id, order_no of the accepted order
    accepted: DataFrame
    #: pair_id, spent
    spent: DataFrame


def places_of(stream: DataFrame) -> DataFrame:
    return stream.select(*m.SIDE, "locator", F.col("pos").alias("place"))


def reordered(stream: DataFrame, order: DataFrame, keys: list[str]) -> DataFrame:
    """keys, locator, place of the left side's instalments: as the order lists them, those it leaves out behind, in their own order.

    stream: keys, locator, pos; order: keys, segment_no, pos, locator, of which the first mention counts."""
    w = Window.partitionBy(*keys).orderBy("segment_no", "pos")
    listed = order.withColumn("_listed", F.row_number().over(w)).groupBy(*keys, "locator").agg(F.min("_listed").alias("_listed"))
    both = stream.join(listed, [*keys, "locator"], "left")
    return ranked(both, keys, [F.asc_nulls_last("_listed"), "pos"], "place").select(*keys, "locator", F.col("place"))


def spans(links: DataFrame, stream: DataFrame, places: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The links with their spans of regular places: l_low, l_high, r_low, r_high. links: keys, link_id, left, right (arrays)."""
    keys = keys or ["pair_id"]
    regular = stream.where("kind = 'regular'").select(*keys, "side", "locator").join(places, [*keys, "side", "locator"])
    out = links
    for side in ("left", "right"):
        at = regular.where(F.col("side") == side).select(*keys, "locator", "place")
        held = links.select(*keys, "link_id", F.explode(side).alias("locator")).join(at, [*keys, "locator"])
        held = held.groupBy(*keys, "link_id").agg(F.min("place").alias(f"{side[0]}_low"), F.max("place").alias(f"{side[0]}_high"))
        out = out.join(held, [*keys, "link_id"], "left")
    return out


def paid_orders(stream: DataFrame, right: DataFrame, orders: DataFrame, left_over: DataFrame) -> Paid:
    """The first of a pair's other orders by which one of the free transforms covers the whole title and whose links don't cross.

    One listing, then one request for each order that is looked into: those with as many instalments as the right side, in their
    listed order, three at most, as far as the budget goes. right: regular segments of the right side; left_over: pair_id, left
    (what the budget still has, null: no bound), list_cost, detail_cost, of the pairs that nothing is placed in yet."""
    listing = left_over.join(orders.select("pair_id").distinct(), "pair_id", "left_semi").where("left IS NULL OR list_cost <= left")
    total = right.groupBy("pair_id").agg(F.count("*").alias("_total"))
    sizes = orders.groupBy("pair_id", "order_no").agg(F.count("*").alias("_n"))
    fitting = sizes.join(listing, "pair_id").join(total, "pair_id").where("_n = _total")
    affordable = F.when(F.col("left").isNull() | (F.col("detail_cost") <= 0), MOST_ORDERS).otherwise(F.floor((F.col("left") - F.col("list_cost")) / F.col("detail_cost")))
    looked = ranked(fitting, ["pair_id"], ["order_no"], "_k").where(F.col("_k") <= F.least(F.lit(MOST_ORDERS), affordable)).select("pair_id", "order_no", "_k")
    looked = cut(looked)
    key = F.struct("pair_id", "order_no").alias("pair_id")
    columns = ["segment_no", "pos", "locator", "air_date", "title"]
    ordered = orders.join(looked, ["pair_id", "order_no"])
    both = ordered.select(key, F.lit("left").alias("side"), *columns).unionByName(right.join(looked, "pair_id").select(key, F.lit("right").alias("side"), *columns))
    links = m.t2_pattern(both).select(F.col("pair_id").alias("_key"), "left", "right", "confidence")
    links = links.select(F.col("_key.pair_id").alias("pair_id"), F.col("_key.order_no").alias("order_no"), "left", "right", "confidence")
    links = cut(links)
    keys = ["pair_id", "order_no"]
    streams = stream.join(looked, "pair_id").select(*keys, "side", "locator", "kind", "pos")
    places = reordered(streams.where("side = 'left'"), ordered.select(*keys, "segment_no", "pos", "locator"), keys).withColumn("side", F.lit("left"))
    places = places.unionByName(streams.where("side = 'right'").select(*keys, "side", "locator", F.col("pos").alias("place")))
    w = Window.partitionBy(*keys).orderBy("left", "right")
    held = spans(links.select(*keys, F.row_number().over(w).alias("link_id"), F.array("left").alias("left"), F.array("right").alias("right")), streams, places, keys)
    good = links.select(*keys).distinct().join(m.broken(held, keys), keys, "left_anti")
    accepted = cut(first_of(good, ["pair_id"], ["order_no"]))
    seen = looked.join(accepted.withColumnRenamed("order_no", "_chosen"), "pair_id", "left").where("_chosen IS NULL OR order_no <= _chosen").groupBy("pair_id").agg(F.count("*").alias("_seen"))
    cost = F.col("list_cost") + F.col("detail_cost") * F.coalesce("_seen", F.lit(0))
    return Paid(links.join(accepted, keys, "left_semi").drop("order_no"), accepted, listing.join(seen, "pair_id", "left").select("pair_id", cost.alias("spent")))


def climb(stream: DataFrame, segments: DataFrame, budgets: DataFrame | None = None, orders: DataFrame | None = None) -> Ladder:
    """All three tiers of every pair, and what becomes of it.

    The first tier is paid for in front; a pair that can't is unmatched in the end, though the others still propose. The second
    stands down where the first placed something, and pays for other orders only where no free transform fits; an accepted
    order replaces the stream's for what follows. The third always runs, on what is not placed yet, and crosses nothing that is.
    What several tiers read is checkpointed, since each tier's plan would hold those before it several times."""
    spark = stream.sparkSession
    pairs = stream.select("pair_id").distinct()
    if budgets is None:
        budgets = spark.createDataFrame([], "pair_id long, most double, t1_cost double, list_cost double, detail_cost double")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    accounts = pairs.join(budgets, "pair_id", "left").select("pair_id", "most", zero("t1_cost"), zero("list_cost"), zero("detail_cost"))
    over = F.coalesce(F.col("t1_cost") > F.col("most"), F.lit(False))
    accounts = accounts.withColumn("over", over).withColumn("t1_spent", F.when(over, 0).otherwise(F.col("t1_cost"))).withColumn("left", F.col("most") - F.col("t1_spent"))
    regular = segments.join(stream.where("kind = 'regular'").select(*m.SIDE, "locator"), [*m.SIDE, "locator"], "left_semi")
    first = m.t1_structure(regular).join(accounts.where("over").select("pair_id"), "pair_id", "left_anti")
    first = cut(first)
    waiting = pairs.join(first.select("pair_id").distinct(), "pair_id", "left_anti")
    free = cut(m.t2_pattern(regular.join(waiting, "pair_id", "left_semi")))
    second, places = free, places_of(stream)
    spent = accounts.select("pair_id", F.lit(TIERS[0]).alias("tier"), F.col("t1_spent").alias("spent"))
    if orders is not None:
        open_ = accounts.join(waiting, "pair_id", "left_semi").join(free.select("pair_id").distinct(), "pair_id", "left_anti")
        paid = paid_orders(stream, regular.where("side = 'right'"), orders, open_.select("pair_id", "left", "list_cost", "detail_cost"))
        second = free.unionByName(paid.links)
        chosen = orders.join(paid.accepted, ["pair_id", "order_no"], "left_semi").drop("order_no")
        left = stream.where("side = 'left'").join(paid.accepted.select("pair_id"), "pair_id", "left_semi")
        anew = reordered(left.select("pair_id", "locator", "pos"), chosen, ["pair_id"]).withColumn("side", F.lit("left"))
        places = places.join(anew.select("pair_id", "side").distinct(), m.SIDE, "left_anti").unionByName(anew)
        places = cut(places)
        spent = spent.unionByName(paid.spent.select("pair_id", F.lit(TIERS[1]).alias("tier"), "spent"))
    placed = first.withColumn("tier", F.lit(TIERS[0])).unionByName(second.withColumn("tier", F.lit(TIERS[1])))
    placed = cut(placed.select("pair_id", "tier", F.array("left").alias("left"), F.array("right").alias("right"), "confidence"))
    third = episode_links(stream, places, placed).select("pair_id", F.lit(TIERS[2]).alias("tier"), "left", "right", F.col("outcome").alias("confidence"))
    links = placed.unionByName(cut(third))
    counts = links.groupBy("pair_id", "tier").agg(F.count("*").alias("n_links"))
    rungs = accounts.select("pair_id", "over", F.explode(F.array(*map(F.lit, TIERS))).alias("tier"))
    kind = F.when(F.col("over") & (F.col("tier") == TIERS[0]), "over-budget").otherwise("proposed")
    trace = rungs.join(counts, ["pair_id", "tier"], "left").join(spent, ["pair_id", "tier"], "left")
    trace = trace.select("pair_id", "tier", kind.alias("kind"), zero("n_links"), F.coalesce("spent", F.lit(0)).cast("double").alias("spent"))
    return Ladder(links, places, trace, outcomes(stream, places, links, accounts.where("over").select("pair_id")))


def episode_links(stream: DataFrame, places: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """The third tier: pair_id, left, right, score, outcome (high or low) over what ``placed`` (pair_id, left, right) leaves."""
    at = stream.join(places, [*m.SIDE, "locator"])
    if placed is None:
        return m.greedy_links(m.candidates(m.units(at))).where("outcome <> 'crossing'")
    ends = placed.select("pair_id", F.lit("left").alias("side"), F.explode("left").alias("locator")).unionByName(placed.select("pair_id", F.lit("right").alias("side"), F.explode("right").alias("locator")))
    marked = at.join(ends.distinct().withColumn("_used", F.lit(True)), [*m.SIDE, "locator"], "left").withColumn("consumed", F.col("_used").isNotNull()).drop("_used")
    w = Window.partitionBy("pair_id").orderBy("left", "right")
    held = spans(placed.select("pair_id", F.row_number().over(w).alias("link_id"), "left", "right"), stream, places)
    return m.greedy_links(m.candidates(m.units(marked)), held.select("pair_id", *m.SPANS)).where("outcome <> 'crossing'")


def outcomes(stream: DataFrame, places: DataFrame, links: DataFrame, over_budget: DataFrame) -> DataFrame:
    """Per pair the alignment's status of all its links, held against ``places``; unmatched where the budget did not do."""
    w = Window.partitionBy("pair_id").orderBy("left", "right")
    numbered = links.select("pair_id", F.row_number().over(w).alias("link_id"), "left", "right")
    held = spans(numbered, stream, places)
    crossed = m.crossings(held.withColumnsRenamed({"l_low": "left_min", "l_high": "left_max", "r_low": "right_min", "r_high": "right_max"}))
    crossed = cut(crossed)
    ends = numbered.select("pair_id", "link_id", F.lit("left").alias("side"), F.explode("left").alias("locator"))
    ends = ends.unionByName(numbered.select("pair_id", "link_id", F.lit("right").alias("side"), F.explode("right").alias("locator")))
    found = m.alignment_status(stream.select("pair_id").distinct(), stream, ends, crossed)
    refused = over_budget.withColumn("_over", F.lit(True))
    return found.join(refused, "pair_id", "left").withColumn("status", F.when(F.col("_over"), "unmatched").otherwise(F.col("status"))).drop("_over")


def complete(stream: DataFrame, links: DataFrame, outcome: DataFrame) -> DataFrame:
    """pair_id, complete, of the published pairs: nothing of either side is pending. links: pair_id, left, right (arrays)."""
    paired = links.select("pair_id", F.lit("left").alias("side"), F.explode("left").alias("locator")).unionByName(links.select("pair_id", F.lit("right").alias("side"), F.explode("right").alias("locator")))
    pending = m.dispositions(stream, paired).where("state = 'pending'").select("pair_id").distinct().withColumn("_pending", F.lit(True))
    return outcome.where("status = 'published'").join(pending, "pair_id", "left").select("pair_id", F.col("_pending").isNull().alias("complete"))


def highest_tried(trace: DataFrame) -> DataFrame:
    """pair_id, highest_tier: the highest rung that proposed, whether or not it placed anything; the third where none did."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    best = F.max(F.when(F.col("kind") == "proposed", rank))
    return trace.groupBy("pair_id").agg(F.get(F.array(*map(F.lit, TIERS)), (F.coalesce(best, F.lit(len(TIERS))) - 1).cast("int")).alias("highest_tier"))


def build_estimate(chains: DataFrame, services: DataFrame, candidates: DataFrame, most: int = 50, fetch_cost: int = 1, verify_cost: int = 1) -> DataFrame:
    """build_id, requests, fits: whether a build is small enough to be run at once, sized before anything is fetched.

    Every segment of the chain is fetched from every target service, every candidate id is verified. chains: build_id, one row a
    segment; services: build_id, service; candidates: build_id, one row a candidate."""
    count = lambda df, name, what="*": df.groupBy("build_id").agg((F.count("*") if what == "*" else F.countDistinct(what)).alias(name))
    all_ = chains.select("build_id").unionByName(services.select("build_id")).unionByName(candidates.select("build_id")).distinct()
    sized = all_
    for part in (count(chains, "_s"), count(services, "_t", "service"), count(candidates, "_c")):
        sized = sized.join(part, "build_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    requests = n("_s") * n("_t") * fetch_cost + n("_c") * verify_cost
    return sized.select("build_id", requests.cast("long").alias("requests"), (requests <= most).alias("fits"))
