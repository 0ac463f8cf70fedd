"""What leads to publication and what callers read of it: plans, hits, candidates, pairings, budgets, blocking conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.identity import admission_error
from tessera.operators.graph import ANIME, first_of

#: Anime catalogues whose instalments can be listed; the two that film and series ids pair with.
ENUMERABLE = ["anilist", "mal"]
OPPOSITE = {"tmdb": "imdb", "imdb": "tmdb"}


def target_plans(titles: DataFrame) -> DataFrame:
    """Targets to fill for each title, none where its profile doesn't admit it. titles: title_id, profile, service."""
    anime = F.array_remove(F.array(*map(F.lit, ENUMERABLE)), F.col("service"))
    opposite = F.create_map(*[F.lit(x) for pair in OPPOSITE.items() for x in pair])[F.col("service")]
    targets = F.when(F.col("profile") == "anime", anime).otherwise(F.array_compact(F.array(opposite)))
    kind = F.when(F.col("profile") == "anime", "enumerated").otherwise("atomic")
    return titles.where(admission_error(F.col("profile"), F.col("service")).isNull()).select("title_id", kind.alias("kind"), F.explode(targets).alias("target"))


def new_hits(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Best score of each hit that isn't a member yet. hits: group_id, ref, score; members: group_id, ref."""
    return hits.join(members, ["group_id", "ref"], "left_anti").groupBy("group_id", "ref").agg(F.max("score").alias("score"))


def firsts_in_order(df: DataFrame, group: str, key: str, order: list) -> DataFrame:
    """Repeated keys of a group fall away but for the first; ``place`` numbers the rest from 0 in the old order."""
    kept = first_of(df, [group, key], order)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def similar_works(items: DataFrame, titles: DataFrame, continuities: DataFrame) -> DataFrame:
    """References to similar works, by continuity where known: host, ref, place; the host itself falls away.

    items: host, pos, ref (a title); titles: title_id, group_id; continuities: group_id, continuity_id."""
    known = titles.join(continuities, "group_id").select(F.col("title_id").alias("ref"), "continuity_id")
    named = items.join(known, "ref", "left").where("continuity_id IS NULL OR continuity_id <> host")
    work = F.coalesce(F.concat(F.lit("continuity:"), F.col("continuity_id").cast("string")), F.concat(F.lit("title:"), F.col("ref").cast("string")))
    return firsts_in_order(named.select("host", "pos", work.alias("work")), "host", "work", ["pos"]).select("host", "work", "place")


def chosen_order(orders: DataFrame, requested: DataFrame) -> DataFrame:
    """continuity_id and slug: the requested order if there is one of that name, else watch, else release.

    orders: continuity_id, slug; requested: continuity_id, wanted."""
    has = orders.groupBy("continuity_id").agg(F.collect_set("slug").alias("_slugs"))
    slug = F.when(F.array_contains("_slugs", F.col("wanted")), F.col("wanted")).when(F.array_contains("_slugs", "watch"), "watch").otherwise("release")
    return requested.join(has, "continuity_id", "left").select("continuity_id", slug.alias("slug"))


def coverage_after_merge(coverage: DataFrame, merges: DataFrame) -> DataFrame:
    """Coverage rows after groups merge: those of retired groups go, and for each service that either had, a pending row
    one revision on is added to the survivor. coverage: group_id, service, revision, state; merges: retired, survivor."""
    retired = merges.select(F.col("retired").alias("group_id"), F.col("survivor").alias("_to"))
    survivors = merges.select(F.col("survivor").alias("group_id"), F.col("survivor").alias("_to")).distinct()
    touched = coverage.join(retired.unionByName(survivors), "group_id")
    seeded = touched.groupBy(F.col("_to").alias("group_id"), "service").agg((F.max("revision") + 1).alias("revision")).withColumn("state", F.lit("pending"))
    return coverage.join(retired, "group_id", "left_anti").unionByName(seeded)


def merged_residue(targets: Column, residue: Column, resolved: Column) -> Column:
    """The agent's residue, then the targets that are neither in it nor resolved; each once, in order."""
    return F.array_distinct(F.concat(residue, F.array_except(targets, F.array_union(residue, resolved))))


def later_wins(facts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, whole, from the input of the largest ``order``; a null in it isn't filled from an earlier one."""
    rest = [c for c in facts.columns if c not in (*keys, order)]
    last = facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def ledger(costs: DataFrame, limit: int) -> DataFrame:
    """Whether each cost of a group is paid, in order: one that would exceed the limit is refused, and the next is tried.

    costs: group_id, pos, cost. What is refused costs nothing, so this is a fold and not a running sum; a group is the
    candidates of one title, and only its positions and costs are gathered."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "cost")))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<struct<pos:int,cost:bigint,paid:boolean>>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        paid = state["spent"] + x["cost"] <= limit
        row = F.struct(x["pos"].alias("pos"), x["cost"].alias("cost"), paid.alias("paid"))
        return F.struct((state["spent"] + F.when(paid, x["cost"]).otherwise(0)).alias("spent"), F.concat(state["done"], F.array(row)).alias("done"))

    typed = costs.select("group_id", F.col("pos").cast("int").alias("pos"), F.col("cost").cast("long").alias("cost"))
    done = typed.groupBy("group_id").agg(F.aggregate(listed, start, step)["done"].alias("_done"))
    return done.select("group_id", F.inline("_done"))


def publication(conflicts: DataFrame, scope: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group whether open conflicts block it and how many: those of which any reference lies in its scope.

    conflicts: conflict_id, refs (array of struct<kind, id>); scope: group_id, kind, id; groups: group_id. One equi-join on
    (kind, id), whatever the kind of conflict."""
    named = conflicts.select("conflict_id", F.inline("refs"))
    hit = named.join(scope, ["kind", "id"]).select("group_id", "conflict_id").distinct().groupBy("group_id").agg(F.count("*").alias("n_conflicts"), F.min("conflict_id").alias("first_conflict"))
    return groups.join(hit, "group_id", "left").select("group_id", F.col("n_conflicts").isNotNull().alias("blocked"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), "first_conflict")


def pairings(aligned: DataFrame, spokes: DataFrame) -> DataFrame:
    """Aligned locators as spoke ids of both sides; a pair of which fewer than two are stored falls away.

    aligned: pair_no, title_id, locator; spokes: spoke_id, title_id, locator."""
    found = aligned.join(spokes, ["title_id", "locator"]).groupBy("pair_no").agg(F.sort_array(F.collect_list("spoke_id")).alias("spoke_ids"))
    return found.where(F.size("spoke_ids") >= 2)


def chosen_units(proposals: DataFrame, held: DataFrame) -> DataFrame:
    """Unit of each proposed instalment: the given one, else that of earlier research, else any held one, else a new one.

    proposals: instalment_id, unit_id (may be null); held: edge_id, instalment_id, unit_id, source."""
    first = F.min(F.struct((F.col("source") != "llm-research").alias("other"), "edge_id", F.col("unit_id").alias("unit")))
    prior = held.groupBy("instalment_id").agg(first.alias("_p"))
    how = F.when(F.col("unit_id").isNotNull(), "given").when(F.col("_p").isNull(), "new").when(F.col("_p.other"), "held").otherwise("research")
    return proposals.join(prior, "instalment_id", "left").select("instalment_id", F.coalesce("unit_id", "_p.unit").alias("unit_id"), how.alias("origin"))


def canonical_key(keys: DataFrame, aliases: DataFrame) -> DataFrame:
    """unit_key under the surviving work: ``continuity:N`` and ``part:continuity:N:i`` follow the alias, others stay.

    aliases: retired, survivor (numbers of works)."""
    form = "^(part:)?continuity:([0-9]+)(:[0-9]+)?$"
    part = lambda i: F.regexp_extract("unit_key", form, i)
    good = F.col("unit_key").rlike(form) & ((part(1) == "") == (part(3) == ""))
    named = keys.withColumn("_n", F.when(good, part(2).try_cast("long")))
    hit = named.join(aliases.select(F.col("retired").alias("_n"), F.col("survivor").alias("_to")), "_n", "left")
    moved = F.concat(part(1), F.lit("continuity:"), F.col("_to").cast("string"), part(3))
    return hit.withColumn("canonical", F.coalesce(moved, "unit_key")).drop("_n", "_to")


def segment_kinds(titles: DataFrame) -> DataFrame:
    """Atomic for TMDB's films and for anime titles whose group holds one, else episodic. titles: title_id, group_id, service, native."""
    film = (F.col("service") == "tmdb") & F.col("native").startswith("movie:")
    beside = F.max(film).over(Window.partitionBy("group_id"))
    return titles.select("title_id", F.when(film | (F.col("service").isin(ANIME) & beside), "atomic").otherwise("episodic").alias("kind"))


def retire_bootstrap(assertions: DataFrame, groups: DataFrame) -> DataFrame:
    """Assertions left when the given groups are aligned: their bootstrap ones go, those of other sources and groups stay.

    assertions: group_id, source and others; groups: group_id."""
    gone = groups.select("group_id", F.lit("bootstrap").alias("source")).distinct()
    return assertions.join(gone, ["group_id", "source"], "left_anti")


def evidence_hash(prefix: str, members: DataFrame, key: str) -> DataFrame:
    """key and evidence_hash: the prefix and the canonical JSON of its members in order. members: key, service, serviceId."""
    refs = F.to_json(F.sort_array(F.collect_list(F.struct("service", "serviceId"))))
    return members.groupBy(key).agg(F.concat(F.lit(f"{prefix}:"), refs).alias("evidence_hash"))


def settled(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status of each candidate: that of the first decision which settles it, as later ones find it closed; else open.

    decisions: candidate_id, verdict (accepted, rejected, or kept, which settles nothing), at, decision_id."""
    first = F.min_by("verdict", F.struct("at", "decision_id")).alias("_verdict")
    done = decisions.where(F.col("verdict").isin("accepted", "rejected")).groupBy("candidate_id").agg(first)
    return candidates.join(done, "candidate_id", "left").select("candidate_id", F.coalesce("_verdict", F.lit("open")).alias("status"))


def rechecked(assertions: DataFrame, records: DataFrame, budget: int) -> DataFrame:
    """Assertions with the verdict of a recheck within the group's budget: those that disagree become low.

    assertions: group_id, assertion_id, pos, cost, stated, confidence; records: assertion_id, found. What the budget refuses
    has no verdict; what no record is staged for is unavailable; neither changes."""
    paid = ledger(assertions, budget).where("paid").select("group_id", "pos", F.lit(True).alias("_paid"))
    both = assertions.join(paid, ["group_id", "pos"], "left").join(records, "assertion_id", "left")
    verdict = F.when(F.col("_paid"), F.when(F.col("found").isNull(), "unavailable").when(F.col("found") == F.col("stated"), "agrees").otherwise("disagrees"))
    after = F.when(verdict == "disagrees", "low").otherwise(F.col("confidence"))
    return both.select("assertion_id", verdict.alias("verdict"), after.alias("confidence"))


def work_metadata(works: DataFrame, by_kind: DataFrame, genres: DataFrame) -> DataFrame:
    """Metadata by the work's media kind; an anime's genres come from TMDB, none where that has no record.

    works: work_id, media_kind; by_kind: work_id, media_kind, title, genres; genres: work_id, tmdb_genres."""
    both = works.join(by_kind, ["work_id", "media_kind"], "left").join(genres, "work_id", "left")
    none = F.array().cast("array<string>")
    chosen = F.when(F.col("media_kind") == "anime", F.coalesce("tmdb_genres", none)).otherwise(F.coalesce("genres", none))
    return both.select("work_id", "title", chosen.alias("genres"))


def opened(outcomes: DataFrame) -> DataFrame:
    """How a search hit opens. outcomes: ref, outcome, continuity_id, retry_after, status_url. Only a pending build has a
    status to ask for; what can be retried waits without one."""
    o = F.col("outcome")
    kind = F.when(o == "complete", "ready").when(o.isin("pending", "retryable"), "pending").otherwise(o)
    shows = lambda c, *of: F.when(o.isin(*of), F.col(c)).alias(c)
    return outcomes.select(
        "ref", kind.alias("kind"), shows("continuity_id", "complete", "pending", "retryable"), shows("retry_after", "pending", "retryable"), shows("status_url", "pending")
    )


def unit_answers(edges: DataFrame) -> DataFrame:
    """Per title and unit the services that cover it elsewhere and how many titles do. edges: as for ``paths``.

    The unit's services are counted once and joined back, so that a unit of n titles gives n rows and not n squared."""
    per = edges.groupBy("unit_id", "service").agg(F.count("*").alias("n"))
    listed = per.groupBy("unit_id").agg(F.sort_array(F.collect_list(F.struct("service", "n"))).alias("_all"))
    others = F.filter("_all", lambda x: x["service"] != F.col("service"))
    found = edges.join(listed, "unit_id").select("title_id", "unit_id", others.alias("_o"))
    total = F.aggregate("_o", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return found.select("title_id", "unit_id", F.array_join(F.transform("_o", lambda x: x["service"]), ",").alias("services"), total.alias("n_counterparts"))
