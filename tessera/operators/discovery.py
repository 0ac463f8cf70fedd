"""Discovery of title groups: chains of relations, verification of runs, convergence, membership."""

from __future__ import annotations

import tempfile
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import day_distance, hit_score, normalise_title, title_similarity, tokens
from tessera.operators.graph import first_of, ranked


def mutual(edges: DataFrame) -> DataFrame:
    """Edges (from_id, to_id) that are returned: evidence from both sides."""
    back = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return edges.join(back.distinct(), ["from_id", "to_id"], "left_semi")


def two_sided_chain(edges: DataFrame) -> DataFrame:
    """Sequel edges with their confidence: high where the later says prequel of the earlier, else low.

    edges: from_id, to_id, kind (sequel or prequel)."""
    back = edges.where("kind = 'prequel'").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.lit(True).alias("_back")).distinct()
    return edges.where("kind = 'sequel'").select("from_id", "to_id").join(back, ["from_id", "to_id"], "left").select(
        "from_id", "to_id", F.when(F.col("_back"), "high").otherwise("low").alias("confidence")
    )


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, which doubles with every round else: checkpointed in the folder of ``spark.checkpoint.dir``.

    Only in local mode may that be unset; a temporary folder stands in for it then."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def walk(nexts: DataFrame, heads: DataFrame, most: int | None = None) -> DataFrame:
    """Whole chains from their heads along sequels: chain_id, node, pos. nexts: from_id, to_id, one edge a node.

    Pointer jumping: after k rounds each node knows the node 2^k steps on, or its end and how far it is, so a chain of n titles takes
    log n rounds, not n. Rounds end when as many nodes have no end as the round before: they lead to cycles. A chain whose end is known is
    written out with each row joined only while its chain goes on; one without, in ``circling``. A cycle ends before the first node it meets
    again. With ``most`` only as many nodes of a chain are wanted, and rounds end there."""
    far, step, endless, jumps = cut(nexts.select("from_id", "to_id", F.lit(1).alias("steps"))), 1, -1, []
    while True:
        on = far.where(F.col("steps") == step)
        jumps.append(on.select("from_id", "to_id"))
        if (n := on.count()) in (0, endless) or (most and step >= most):
            break
        endless = n
        further = far.select(F.col("from_id").alias("_at"), F.col("to_id").alias("_to"), F.col("steps").alias("_steps"))
        grown = on.join(further, F.col("to_id") == F.col("_at"), "left")
        grown = grown.select("from_id", F.coalesce("_to", "to_id").alias("to_id"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
        far = cut(grown.unionByName(far.where(F.col("steps") < step)))
        step *= 2
    last = F.when(F.col("steps").isNull(), 0).when(F.col("steps") < step, F.col("steps"))
    begun = heads.select("node").distinct().join(far, F.col("node") == F.col("from_id"), "left")
    begun = cut(begun.select(F.col("node").alias("chain_id"), "node", F.lit(0).alias("pos"), last.alias("last")))
    reach = begun.where("last IS NOT NULL")
    for k, jump in enumerate(jumps[:-1]):
        more = reach.where(F.col("pos") + 2**k <= F.col("last")).join(jump, F.col("node") == F.col("from_id"))
        reach = reach.unionByName(cut(more.select("chain_id", F.col("to_id").alias("node"), (F.col("pos") + 2**k).alias("pos"), "last")))
    rest = begun.where("last IS NULL").select("chain_id", "node", "pos")
    reach = reach.select("chain_id", "node", "pos")
    reach = reach.unionByName(circling(jumps, rest, most)) if n and not rest.isEmpty() else reach
    return reach.where(F.col("pos") < most) if most else reach


def circling(jumps: list[DataFrame], reach: DataFrame, most: int | None) -> DataFrame:
    """Chains that may lead to cycles, from their first rows; ``jumps`` hold the first rounds' edges over 1, 2, 4 ... steps."""
    k, known = 0, -1
    while (n := reach.count()) > known and not (most and 2**k >= most):
        known = n
        if k == len(jumps):
            a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
            jumps.append(cut(a.join(b, F.col("a.to_id") == F.col("b.from_id")).select(F.col("a.from_id").alias("from_id"), F.col("b.to_id").alias("to_id"))))
        more = reach.join(jumps[k], F.col("node") == F.col("from_id")).select("chain_id", F.col("to_id").alias("node"), (F.col("pos") + 2**k).alias("pos"))
        reach = cut(reach.unionByName(more).groupBy("chain_id", "node").agg(F.min("pos").alias("pos")))
        k += 1
    return reach


class Continuity(NamedTuple):
    #: chain_id (the start), node, pos from 0: the whole chain, of starts that nothing is refused to
    chains: DataFrame
    #: chain_id, reason, entry_id, competing (from_id, kind, to_id)
    refusals: DataFrame


def continuity(entries: DataFrame, relations: DataFrame, starts: DataFrame) -> Continuity:
    """The chain of each start: back along prequels, then forward along sequels, or why it can't be told.

    ambiguous-branch: the start or an entry on the way has two edges of a direction (prequels before sequels); non-anime-candidate:
    the start isn't anime, or an edge leads to a show; cycle-closing-link: an edge leads to what was walked. What is met first counts, the
    way back before the way forward; an entry that is not there ends a way. Films are parts of chains. entries: entry_id, type;
    relations: from_id, kind (others than prequel and sequel are passed over), to_id; starts: entry_id.

    Both ways are walked by doubling (``walk``), over the edges that can be gone; what stands at a way's end is looked up once."""
    edges = relations.where("kind IN ('prequel', 'sequel')").select("from_id", "kind", "to_id")
    listed = F.sort_array(F.collect_list(F.struct("from_id", "kind", "to_id")))
    several = edges.groupBy("from_id", "kind").agg(F.count("*").alias("n"), listed.alias("competing")).where("n > 1")
    branching = first_of(several, ["from_id"], ["kind"]).select(F.col("from_id").alias("entry_id"), "competing")
    state = entries.join(branching, "entry_id", "left").select("entry_id", "type", "competing")
    single = edges.join(several.select("from_id").distinct(), "from_id", "left_anti")
    to = state.select(F.col("entry_id").alias("to_id"), F.col("type").alias("_type"), "competing")
    step = F.when(F.col("_type").isNull(), "end").when(F.col("_type") == "show", "non-anime-candidate").when(F.col("competing").isNotNull(), "ambiguous-branch").otherwise("go")
    steps = cut(single.join(to, "to_id", "left").select("from_id", "kind", "to_id", step.alias("step"), "competing"))

    begun = starts.distinct().join(state, "entry_id")
    nothing = F.array().cast(dict(steps.dtypes)["competing"])
    reason = F.when(F.col("type") != "anime", "non-anime-candidate").when(F.col("competing").isNotNull(), "ambiguous-branch")
    begun = begun.withColumn("reason", reason)
    refused = begun.where("reason IS NOT NULL").select(
        F.col("entry_id").alias("chain_id"), "reason", "entry_id", F.when(F.col("reason") == "ambiguous-branch", F.col("competing")).otherwise(nothing).alias("competing")
    )
    good = begun.where("reason IS NULL").select(F.col("entry_id").alias("node"))

    def ends(way: DataFrame, kind: str) -> DataFrame:
        """The refusals at the ends of ways (chain_id, node, pos)."""
        last = way.groupBy("chain_id").agg(F.max_by("node", "pos").alias("from_id"))
        at = last.join(steps.where(F.col("kind") == kind), "from_id").where("step <> 'end'")
        edge = F.array(F.struct("from_id", "kind", "to_id"))
        found = F.when(F.col("step") == "go", "cycle-closing-link").otherwise(F.col("step"))
        entry = F.when(F.col("step") == "go", F.col("from_id")).otherwise(F.col("to_id"))
        return at.select("chain_id", found.alias("reason"), entry.alias("entry_id"), F.when(F.col("step") == "ambiguous-branch", F.col("competing")).otherwise(edge).alias("competing"))

    go = lambda kind: steps.where((F.col("kind") == kind) & (F.col("step") == "go"))
    back = walk(go("prequel"), good)
    refused_back = cut(ends(back, "prequel"))
    good = good.join(refused_back.select(F.col("chain_id").alias("node")), "node", "left_anti")
    ahead = walk(go("sequel"), good)
    met = ahead.where("pos > 0").join(back.where("pos > 0").select("chain_id", "node"), ["chain_id", "node"]).groupBy("chain_id").agg(F.min("pos").alias("_met"))
    ahead = cut(ahead.join(met, "chain_id", "left").where("_met IS NULL OR pos < _met").drop("_met"))
    refused_ahead = cut(ends(ahead, "sequel"))
    refusals = refused.unionByName(refused_back).unionByName(refused_ahead)
    whole = good.select(F.col("node").alias("chain_id")).join(refused_ahead.select("chain_id"), "chain_id", "left_anti")
    behind = back.groupBy("chain_id").agg(F.max("pos").alias("_n"))
    rows = ahead.where("pos > 0").select("chain_id", "node", "pos").unionByName(back.select("chain_id", "node", (-F.col("pos")).alias("pos")))
    chains = rows.join(whole, "chain_id", "left_semi").join(behind, "chain_id").select("chain_id", "node", (F.col("pos") + F.col("_n")).alias("pos"))
    return Continuity(chains, refusals)


def branches(edges: DataFrame) -> DataFrame:
    """Nodes with more than one edge of a direction: their chain is ambiguous. edges: from_id, to_id, kind."""
    return edges.groupBy("from_id", "kind").agg(F.countDistinct("to_id").alias("n")).where("n > 1").select(F.col("from_id").alias("node"), "kind", "n")


def verify_runs(runs: DataFrame) -> DataFrame:
    """Verdict on target runs against the target's own record.

    runs: run_id, size (null: unknown), target_count, date, target_date, title, target_title, format_agrees, related. A count that
    differs or dates over a year apart conflict; without counts the run stays a candidate; an exact count is asserted,
    high with a date, title, format or relation that agrees."""
    gap = day_distance(F.col("date"), F.col("target_date"))
    counted = F.col("size").isNotNull() & F.col("target_count").isNotNull()
    agrees = F.coalesce(gap <= 366, F.lit(False)) | F.coalesce(title_similarity(F.col("title"), F.col("target_title")) >= 0.5, F.lit(False)) | F.coalesce("format_agrees", F.lit(False)) | F.coalesce("related", F.lit(False))
    verdict = (
        F.when(counted & (F.col("size") != F.col("target_count")), "count-mismatch")
        .when(gap > 366, "date-mismatch")
        .when(~counted, "candidate")
        .when(agrees, "assert-high")
        .otherwise("assert-low")
    )
    return runs.select("run_id", verdict.alias("verdict"))


def summed(df: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Sums that are unknown if any part is."""
    return df.groupBy(*keys).agg(F.when(F.count("*") == F.count(size), F.sum(size)).alias("total"))


def member_order(titles: DataFrame) -> DataFrame:
    """Places of a group's members: by date, those without one last, then id and service."""
    return ranked(titles, ["group_id"], [F.asc_nulls_last("date"), "native", "service"], "place")


def bucket_hits(hits: DataFrame, members: int = 2, least: float = 0.7) -> DataFrame:
    """Search hits as member (the best ones of at least ``least``), over-cap, or also-considered.

    hits: query_id, ref, score; of repeated refs the best score counts."""
    best = hits.groupBy("query_id", "ref").agg(F.max("score").alias("score"))
    placed = ranked(best, ["query_id"], [F.desc("score"), "ref"], "place")
    kind = F.when(F.col("score") < least, "also-considered").when(F.col("place") <= members, "member").otherwise("over-cap")
    return placed.select("query_id", "ref", "score", "place", kind.alias("bucket"))


class Fuzzy(NamedTuple):
    #: query_id, ref, score, place, bucket (member, over-cap or also-considered)
    hits: DataFrame
    #: query_id, outcome (queued, suppressed or no-proposal), evidence (the members' refs in order, joined by commas)
    proposals: DataFrame


def title_hits(queries: DataFrame, titles: DataFrame, results: int = 8) -> DataFrame:
    """query_id, service, ref, score: the best titles of a query's service that share a word with it, none of the subject's own group.

    Equal texts are compared once, however many rows have them. Words of the different texts meet in an inverted index: both sides'
    words are joined, and the number of shared words of each pair gives their overlap without comparing sets. Rows of one text and
    year have one score, so that the first ones by ref stand for all of them: as many of each group, then twice as many in all, since a
    query passes over one group. queries: query_id, service, title, year, group_id; titles: ref, service, title, year, group_id."""
    asked = cut(queries.select("query_id", "service", F.col("group_id").alias("q_group"), F.col("year").alias("q_year"), normalise_title(F.col("title")).alias("q_title")))
    held = titles.select("ref", "service", "group_id", F.col("year").alias("t_year"), normalise_title(F.col("title")).alias("t_title"))

    def first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
        """As many rows of each key as any query needs, whichever group it passes over."""
        own = ranked(df, [*keys, "group_id"], order, "_own").where(F.col("_own") <= results)
        return ranked(own, keys, order, "_all").where(F.col("_all") <= 2 * results).drop("_own", "_all")

    # a text of a year: its first rows, and how many a query finds in it at least
    kinds = ["service", "t_title", "t_year"]
    rows = cut(first(held, kinds, ["ref"]))
    sizes = rows.groupBy(*kinds, "group_id").agg(F.count("*").alias("_n")).groupBy(*kinds).agg((F.sum("_n") - F.max("_n")).alias("sure"))

    def words(df: DataFrame, side: str) -> DataFrame:
        texts = df.select("service", f"{side}_title").distinct().withColumn("_w", F.array_distinct(tokens(F.col(f"{side}_title"))))
        return texts.select("service", f"{side}_title", F.size("_w").alias(f"{side}_size"), F.explode("_w").alias("word"))

    met = words(asked, "q").join(words(rows, "t"), ["service", "word"])
    shared = met.groupBy("service", "q_title", "t_title", "q_size", "t_size").agg(F.count("*").alias("shared"))
    overlap = F.col("shared") / (F.col("q_size") + F.col("t_size") - F.col("shared"))
    edits = 1 - F.levenshtein("q_title", "t_title") / F.greatest(F.length("q_title"), F.length("t_title"))
    similar = cut(shared.select("service", "q_title", "t_title", (edits * 0.5 + overlap * 0.5).alias("similarity")))
    # rounded, so that equal scores are ties however they were added up
    score = F.round(hit_score(F.col("similarity"), F.col("q_year"), F.col("t_year")), 9)
    wanted = asked.select("service", "q_title", "q_year").distinct()
    scored = wanted.join(similar, ["service", "q_title"]).join(sizes, ["service", "t_title"]).withColumn("score", score)
    # what scores less than enough others can't be among the best
    better = Window.partitionBy("service", "q_title", "q_year").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    enough = scored.withColumn("_here", F.sum("sure").over(better)).withColumn("_before", F.col("_here") - F.sum("sure").over(Window.partitionBy("service", "q_title", "q_year", "score")))
    near = enough.where(F.col("_before") < results).select("service", "q_title", "q_year", "t_title", "t_year", "score")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in kinds]
    found = near.alias("n").join(rows.alias("r"), same).select("n.service", "q_title", "q_year", "ref", "group_id", "score")
    asks = ["service", "q_title", "q_year"]
    best = first(found, asks, [F.desc("score"), "ref"]).select(*[F.col(c).alias(f"_{c}") for c in asks], "ref", "group_id", "score")
    own = asked.join(best, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asks]).where("NOT q_group <=> group_id")
    return ranked(own, ["query_id", "service"], [F.desc("score"), "ref"]).where(F.col("_rank") <= results).select("query_id", "service", "ref", "score")


def fuzzy(queries: DataFrame, titles: DataFrame, rejected: DataFrame) -> Fuzzy:
    """What is proposed for titles that exact evidence leaves unpaired: their hits in buckets, and whether the case is queued.

    A query with no member proposes nothing; one whose very members were rejected before is suppressed. queries and titles: as for
    ``title_hits``, a query_id once for each service it asks; rejected: query_id, evidence."""
    hits = cut(bucket_hits(title_hits(queries, titles)))
    members = hits.where("bucket = 'member'").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.col("ref"))).cast("array<string>"), ",").alias("evidence"))
    known = rejected.select("query_id", "evidence").distinct().withColumn("_rejected", F.lit(True))
    asked = queries.select("query_id").distinct().join(members, "query_id", "left").join(known, ["query_id", "evidence"], "left")
    outcome = F.when(F.col("evidence").isNull(), "no-proposal").when(F.col("_rejected"), "suppressed").otherwise("queued")
    return Fuzzy(hits, asked.select("query_id", outcome.alias("outcome"), "evidence"))


def converge(discovered: DataFrame, stored: DataFrame) -> DataFrame:
    """What becomes of each discovery that touches stored groups.

    discovered: discovery_id, title_id; stored: title_id, group_id, curated. Fewer than two groups: none; a curated group, or a
    stored member that the discovery doesn't name: candidate; else merge into the smallest group id."""
    touched = discovered.join(stored.select("title_id", "group_id"), "title_id").select("discovery_id", "group_id").distinct()
    named = discovered.select("discovery_id", "title_id", F.lit(True).alias("_named"))
    members = touched.join(stored, "group_id").join(named, ["discovery_id", "title_id"], "left")
    out = members.groupBy("discovery_id").agg(
        F.countDistinct("group_id").alias("n_groups"), F.min("group_id").alias("survivor"), F.bool_or("curated").alias("_curated"), F.bool_or(F.col("_named").isNull()).alias("_unnamed")
    )
    plan = F.when(F.col("n_groups") < 2, "none").when(F.col("_curated"), "candidate-curated").when(F.col("_unnamed"), "candidate-unnamed").otherwise("merge")
    return out.select("discovery_id", "n_groups", plan.alias("plan"), F.when(plan == "merge", F.col("survivor")).alias("survivor"))


def merge_members(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    """New ordinals of merged groups: the discovery's order, then what it doesn't name by service and id, from 0.

    stored: group_id, title_id, service; discovered: title_id, ordinal."""
    both = stored.join(discovered, "title_id", "left")
    w = Window.partitionBy("group_id").orderBy(F.asc_nulls_last("ordinal"), "service", "title_id")
    return both.select("group_id", "title_id", (F.row_number().over(w) - 1).alias("ordinal"))
