"""The matching ladder over ordered streams of instalments; every relation is keyed by pair_id.

Streams: pair_id, side, pos, locator, kind (regular or special), boundary (airing, complete or truncated), air_date, runtime,
title. The three tiers are plans (``ladder`` puts them together); only the greedy choice of the third is sequential, and runs as a grouped map over the
candidates that are good enough to be chosen at all.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scores import position_bonus, runtime_bonus
from tessera.functions.text import day_distance, normalise_title, normalised_similarity
from tessera.operators.graph import ranked

MID, HIGH = 0.5, 0.8
SIDE = ["pair_id", "side"]
SPANS = ["l_low", "l_high", "r_low", "r_high"]


def main_sequence(stream: DataFrame) -> DataFrame:
    """Running number of the regular instalments; null for specials."""
    w = Window.partitionBy(*SIDE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("offset", F.when(F.col("kind") == "regular", F.count_if(F.col("kind") == "regular").over(w) - 1))


def runs(df: DataFrame, keys: list[str], order: str, same: list[str], broken) -> DataFrame:
    """Gaps and islands: run number of adjacent rows that agree in ``same``; a row where ``broken`` holds is in no run."""
    w = Window.partitionBy(*keys).orderBy(order)
    alike = ~F.coalesce(F.lag(broken).over(w), F.lit(True)) & ~broken
    for c in same:
        alike = alike & F.coalesce(F.lag(c).over(w) == F.col(c), F.lit(False))
    starts = df.withColumn("_broken", broken).withColumn("_new", F.when(alike, 0).otherwise(1))
    return starts.withColumn("run", F.when(~F.col("_broken"), F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_new", "_broken")


def ranges(df: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """Sizes laid end to end: first and last place (from 1) of each."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("last", F.sum(size).over(w)).withColumn("first", F.col("last") - F.col(size) + 1)


def t1_structure(segments: DataFrame) -> DataFrame:
    """Links of pairs whose two sides have the same segments, sizes and numbers, and whose first and last air dates agree.

    segments: pair_id, side, segment_no, pos, number, locator, air_date. All of a pair or nothing; an air date that is missing or
    can't be read agrees with anything."""
    side = lambda s: segments.where(F.col("side") == s).drop("side")
    left, right = side("left"), side("right").select("pair_id", "segment_no", "pos", *[F.col(c).alias(f"r_{c}") for c in ("number", "locator", "air_date")])
    size = Window.partitionBy("pair_id", "segment_no")
    both = left.join(right, ["pair_id", "segment_no", "pos"], "full").withColumn("_last", F.max("pos").over(size)).withColumn("_first", F.min("pos").over(size))
    gap = day_distance(F.col("air_date"), F.col("r_air_date"))
    checked = (F.col("pos") == F.col("_first")) | (F.col("pos") == F.col("_last"))
    good = F.coalesce(F.col("number") == F.col("r_number"), F.lit(False)) & (~checked | gap.isNull() | (gap <= 1))
    fits = both.withColumn("_good", good).withColumn("_all", F.min(F.col("_good").cast("int")).over(Window.partitionBy("pair_id")))
    return fits.where("_all = 1").select("pair_id", F.col("locator").alias("left"), F.col("r_locator").alias("right"), F.lit("high").alias("confidence"))


def _verdict(title, r_title, air_date, r_air_date):
    """1 where two instalments agree, -1 where they disagree, 0 without evidence: dates a day apart at most, else titles."""
    gap = day_distance(air_date, r_air_date)
    a, b = normalise_title(F.coalesce(title, F.lit(""))), normalise_title(F.coalesce(r_title, F.lit("")))
    return F.when(gap.isNotNull(), F.when(gap <= 1, 1).otherwise(-1)).when((a != "") & (b != ""), F.when(a == b, 1).otherwise(-1)).otherwise(0)


def t2_pattern(segments: DataFrame) -> DataFrame:
    """Links of pairs that one of two transforms covers as a whole, the first that is accepted: segment numbers shifted by a
    constant (not 0) with equal segments and sizes, else equal totals paired by cumulative place.

    Accepted is what nowhere disagrees and agrees at least once. segments: pair_id, side, segment_no, pos, locator, air_date,
    title, of the regular instalments."""
    segment = Window.partitionBy(*SIDE).orderBy("segment_no")
    inner = Window.partitionBy(*SIDE, "segment_no").orderBy("pos")
    placed = segments.select(
        *SIDE, "segment_no", "locator", "air_date", "title", F.dense_rank().over(segment).alias("index"), F.row_number().over(inner).alias("inside"),
        F.row_number().over(Window.partitionBy(*SIDE).orderBy("segment_no", "pos")).alias("place"),
    )
    sizes = placed.groupBy(*SIDE, "segment_no", "index").agg(F.count("*").alias("n"))
    first = F.min("segment_no")
    shape = F.transform(F.sort_array(F.collect_list(F.struct("index", "segment_no", "n"))), lambda x: F.struct(x["index"], x["n"]))
    shift = F.transform(F.sort_array(F.collect_list(F.struct("index", "segment_no"))), lambda x: x["segment_no"])
    sides = sizes.groupBy(*SIDE).agg(shape.alias("shape"), first.alias("first"), shift.alias("numbers"), F.sum("n").alias("total"))
    of = lambda d, c, x: d.where(F.col("side") == x).select("pair_id", *[F.col(k).alias(f"{x[0]}_{k}") for k in c])
    both = of(sides, ["shape", "first", "numbers", "total"], "left").join(of(sides, ["shape", "first", "numbers", "total"], "right"), "pair_id")
    relative = lambda k: F.transform(f"{k}_numbers", lambda x: x - F.col(f"{k}_first"))
    shifted = (F.col("l_shape") == F.col("r_shape")) & (F.col("l_first") != F.col("r_first")) & (relative("l") == relative("r"))
    fits = F.array_compact(F.array(F.when(shifted, 0), F.when(F.col("l_total") == F.col("r_total"), 1)))
    fits = both.select("pair_id", F.explode(fits).alias("transform"))
    columns = ["locator", "air_date", "title", "index", "inside", "place"]
    left, right = of(placed, columns, "left").join(fits, "pair_id"), of(placed, columns, "right")
    cells = ["index", "inside"]
    by_segment = left.where("transform = 0").join(right, (left.pair_id == right.pair_id) & (F.col("l_index") == F.col("r_index")) & (F.col("l_inside") == F.col("r_inside"))).drop(right.pair_id)
    by_place = left.where("transform = 1").join(right, (left.pair_id == right.pair_id) & (F.col("l_place") == F.col("r_place"))).drop(right.pair_id)
    zipped = by_segment.unionByName(by_place).drop(*[f"{k}_{c}" for k in "lr" for c in cells])
    judged = zipped.withColumn("_v", _verdict(F.col("l_title"), F.col("r_title"), F.col("l_air_date"), F.col("r_air_date")))
    accepted = judged.groupBy("pair_id", "transform").agg(F.min("_v").alias("worst"), F.max("_v").alias("best")).where("worst >= 0 AND best = 1")
    chosen = accepted.groupBy("pair_id").agg(F.min("transform").alias("transform"))
    return judged.join(chosen, ["pair_id", "transform"], "left_semi").select(
        "pair_id", F.col("l_locator").alias("left"), F.col("r_locator").alias("right"), F.lit("high").alias("confidence")
    )


def units(stream: DataFrame) -> DataFrame:
    """Scoring units: every instalment, and every run of two or more neighbours of one air date taken together.

    A combined unit has the summed runtime if all are timed, the mean position, and the joined title. ``seq`` keeps the
    order in which a reader of the stream would meet them. A stream may have two more columns: ``consumed`` (placed by an
    earlier tier: no unit, and it ends a run, but it keeps its position) and ``place`` (the order that links are held against,
    else pos; spans are given in it)."""
    consumed = F.col("consumed") if "consumed" in stream.columns else F.lit(False)
    at = F.col("place") if "place" in stream.columns else F.col("pos")
    n = F.count("*").over(Window.partitionBy(*SIDE))
    placed = stream.withColumn("_at", at).withColumn("_consumed", consumed).withColumn("position", F.col("pos") / F.greatest(F.lit(1), n - 1))
    held = runs(placed, SIDE, "pos", ["air_date"], F.col("air_date").isNull() | F.col("_consumed"))
    timed = F.bool_and(F.coalesce(F.col("runtime") > 0, F.lit(False)))
    regular = F.when(F.col("kind") == "regular", F.col("_at"))

    def fold(df: DataFrame, keys: list[str]) -> DataFrame:
        titles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("title", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
        return df.groupBy(*SIDE, *keys).agg(
            F.min("air_date").alias("air_date"),
            F.bool_or(F.col("kind") == "special").alias("special"),
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "locator"))), lambda x: x["locator"]).alias("locators"),
            F.avg("position").alias("position"),
            F.when(timed, F.sum("runtime")).alias("runtime"),
            normalise_title(titles).alias("title"),
            F.max("pos").alias("at"),
            F.count("*").alias("size"),
            F.min(regular).alias("low"),
            F.max(regular).alias("high"),
        )

    single = fold(placed.where("NOT _consumed"), ["pos"]).drop("pos")
    combined = fold(held.where("run IS NOT NULL"), ["run"]).where("size > 1").drop("run")
    both = single.unionByName(combined)
    return ranked(both, SIDE, ["at", "size"], "seq")


def candidates(all_units: DataFrame) -> DataFrame:
    """Scored candidates: pair_id, left, right (locators), score, left_seq, right_seq, and the units' spans of regular
    instalments (l_low to r_high, null for specials); an equi-join within a pair.

    At least one of air date and title must be comparable; dates more than a day apart rule a candidate out."""
    names = ("air_date", "special", "locators", "position", "runtime", "title", "seq", "low", "high")
    side = lambda s, p: all_units.where(F.col("side") == s).select("pair_id", *[F.col(c).alias(f"{p}_{c}") for c in names])
    both = side("left", "l").join(side("right", "r"), "pair_id")
    gap = day_distance(F.col("l_air_date"), F.col("r_air_date"))
    both = both.withColumn("_gap", gap).where("_gap IS NULL OR _gap <= 1")
    by_date = 0.9 - F.col("_gap") * 0.12
    by_title = F.when((F.col("l_title") != "") & (F.col("r_title") != ""), normalised_similarity(F.col("l_title"), F.col("r_title")))
    base = F.when(by_date.isNotNull() & by_title.isNotNull(), (by_date + by_title) / 2).otherwise(F.coalesce(by_date, by_title))
    special = F.col("l_special") | F.col("r_special")
    score = base + runtime_bonus(F.col("l_runtime"), F.col("r_runtime")) + position_bonus(F.col("l_position"), F.col("r_position"), special)
    scored = both.withColumn("score", score).where("score IS NOT NULL")
    return scored.select("pair_id", F.col("l_locators").alias("left"), F.col("r_locators").alias("right"), "score", F.col("l_seq").alias("left_seq"), F.col("r_seq").alias("right_seq"), *SPANS)


class Spans:
    """Spans of chosen links that cross nothing, each (left span or None, right span or None), in sorted lists.

    What a new link could cross stands next to where it would be put in: links of both sides run in one order."""

    def __init__(self) -> None:
        self.sides: tuple[list, list] = ([], [])
        self.both: list[tuple] = []
        self.broken = False  # links that earlier tiers placed may cross one another

    def crosses(self, own: tuple) -> bool:
        for held, span in zip(self.sides, own, strict=True):
            if span is not None:
                k = bisect_left(held, span)
                if k < len(held) and held[k][0] <= span[1] or k and held[k - 1][1] >= span[0]:
                    return True
        if None in own:
            return False
        k = bisect_left(self.both, own)
        return k < len(self.both) and self.both[k][1] < own[1] or k > 0 and self.both[k - 1][1] > own[1]

    def add(self, own: tuple) -> None:
        for held, span in zip(self.sides, own, strict=True):
            if span is not None:
                insort(held, span)
        if None not in own:
            insort(self.both, own)


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads the rows of each pair in order; what is chosen of one pair is all that is held."""
    pair, taken, spans = None, (set(), set()), Spans()
    for pdf in batches:
        bounds = pdf[SPANS].astype("float64").to_numpy()
        out = []
        for key, left, right, score, given, (a, b, c, d) in zip(pdf["pair_id"], pdf["left"], pdf["right"], pdf["score"], pdf["given"], bounds, strict=True):
            if key != pair:
                pair, taken, spans = key, (set(), set()), Spans()
            own = (None if a != a else (a, b), None if c != c else (c, d))
            if given:
                spans.broken = spans.broken or spans.crosses(own)
                spans.add(own)
                continue
            left, right = list(left), list(right)
            if not taken[0].isdisjoint(left) or not taken[1].isdisjoint(right):
                continue
            crosses = spans.broken or spans.crosses(own)
            if not crosses:
                taken[0].update(left)
                taken[1].update(right)
                spans.add(own)
            out.append((key, left, right, score, "crossing" if crosses else "high" if score >= HIGH else "low"))
        yield pd.DataFrame(out, columns=["pair_id", "left", "right", "score", "outcome"])


def greedy_links(scored: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """The greedy choice: best score first, no locator twice, nothing that crosses what is chosen or what earlier tiers placed.

    outcome: high, low (to be reviewed), or crossing (dropped, but it had a counterpart). Candidates under the middle band
    can't be chosen and don't enter. A pair's rows stand together in score order and are read one by one; each has its units'
    spans, so no stream is held. placed: pair_id and spans of the links that are there (l_low to r_high)."""
    columns = ["pair_id", "left", "right", "score", "left_seq", "right_seq", *SPANS]
    rows = scored.where(F.col("score") >= MID).select(*columns, F.lit(False).alias("given"))
    if placed is not None:
        none = F.array().cast("array<string>")
        given = placed.select("pair_id", none.alias("left"), none.alias("right"), F.lit(2.0).alias("score"), F.lit(0).alias("left_seq"), F.lit(0).alias("right_seq"), *SPANS, F.lit(True).alias("given"))
        rows = rows.unionByName(given)
    dealt = rows.repartition("pair_id").sortWithinPartitions("pair_id", F.desc("given"), F.desc("score"), "left_seq", "right_seq")
    return dealt.mapInPandas(_greedy, "pair_id long, left array<string>, right array<string>, score double, outcome string")


def broken(links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The keys (pair_id) any two of whose links overlap on a side or are inverted, found in one sorted pass a side.

    links: keys, l_low, l_high, r_low, r_high (null where a side has no regular instalment). A link that begins before an earlier
    one has ended overlaps it; where none does, links of both sides in the order of the left must run forward on the right."""
    keys = keys or ["pair_id"]

    def against(low: str, high: str, order: list[str], present: list[str]) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = links.where(" AND ".join(f"{c} IS NOT NULL" for c in present))
        return rows.withColumn("_before", F.max(high).over(before)).where(F.col(low) <= F.col("_before")).select(*keys)

    left, right = ["l_low", "l_high"], ["r_low", "r_high"]
    found = against(*left, left, ["l_low"]).unionByName(against(*right, right, ["r_low"]))
    return found.unionByName(against(*right, [*left, *right], ["l_low", "r_low"])).distinct()


def crossings(links: DataFrame) -> DataFrame:
    """Pairs of links of one pair_id that overlap on a side or are inverted: a self-join within the pairs that have any.

    links: pair_id, link_id, left_min, left_max, right_min, right_max (null where a side has no regular instalment)."""
    spans = dict(zip(["left_min", "left_max", "right_min", "right_max"], SPANS, strict=True))
    links = links.join(broken(links.withColumnsRenamed(spans)), "pair_id", "left_semi")
    a = links.select("pair_id", *[F.col(c).alias(f"a_{c}") for c in ("link_id", "left_min", "left_max", "right_min", "right_max")])
    b = links.select("pair_id", *[F.col(c).alias(f"b_{c}") for c in ("link_id", "left_min", "left_max", "right_min", "right_max")])
    both = a.join(b, "pair_id").where("a_link_id < b_link_id")

    def order(s: str):
        before, after = F.col(f"a_{s}_max") < F.col(f"b_{s}_min"), F.col(f"b_{s}_max") < F.col(f"a_{s}_min")
        return F.when(F.col(f"a_{s}_min").isNull() | F.col(f"b_{s}_min").isNull(), F.lit(None)).when(before, "before").when(after, "after").otherwise("overlap")

    both = both.withColumn("_l", order("left")).withColumn("_r", order("right"))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("_l") == "overlap", "left-overlap"),
            F.when(F.col("_r") == "overlap", "right-overlap"),
            F.when((F.col("_l") != "overlap") & (F.col("_r") != "overlap") & (F.col("_l") != F.col("_r")), "inversion"),
        )
    )
    return both.withColumn("kind", F.explode(kinds)).select("pair_id", F.col("a_link_id").alias("earlier"), F.col("b_link_id").alias("later"), "kind")


def dispositions(stream: DataFrame, paired: DataFrame) -> DataFrame:
    """Unpaired instalments: pending behind the last paired one of an airing stream, else without a counterpart.

    paired: pair_id, side, locator."""
    marked = stream.join(paired.select(*SIDE, "locator", F.lit(True).alias("_paired")).distinct(), [*SIDE, "locator"], "left")
    last = F.coalesce(F.max(F.when(F.col("_paired"), F.col("pos"))).over(Window.partitionBy(*SIDE)), F.lit(-1))
    out = marked.withColumn("_last", last).where("_paired IS NULL")
    state = F.when((F.col("boundary") == "truncated") | ((F.col("boundary") == "airing") & (F.col("pos") > F.col("_last"))), "pending").otherwise("no-counterpart")
    return out.select(*SIDE, "locator", state.alias("state"))


def alignment_status(pairs: DataFrame, stream: DataFrame, links: DataFrame, crossed: DataFrame) -> DataFrame:
    """Per pair: unpublishable (a truncated side), invalid (stray or reused locators), conflict (crossings), published.

    links: pair_id, link_id, side, locator."""
    cut = stream.groupBy("pair_id").agg(F.bool_or(F.col("boundary") == "truncated").alias("_cut"))
    known = stream.select("pair_id", "side", "locator", F.lit(1).alias("_known"))
    strays = links.join(known, ["pair_id", "side", "locator"], "left").groupBy("pair_id").agg(F.count_if(F.col("_known").isNull()).alias("n_strays"))
    reused = links.groupBy("pair_id", "side", "locator").agg(F.countDistinct("link_id").alias("n")).where("n > 1").groupBy("pair_id").agg(F.count("*").alias("n_reused"))
    crossed = crossed.groupBy("pair_id").agg(F.count("*").alias("n_crossings"))
    all_ = pairs
    for part in (cut, strays, reused, crossed):
        all_ = all_.join(part, "pair_id", "left")
    all_ = all_.fillna(0, ["n_strays", "n_reused", "n_crossings"])
    status = F.when(F.col("_cut"), "unpublishable").when(F.col("n_strays") + F.col("n_reused") > 0, "invalid").when(F.col("n_crossings") > 0, "conflict").otherwise("published")
    return all_.select("pair_id", "n_strays", "n_reused", "n_crossings", status.alias("status"))
