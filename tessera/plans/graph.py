"""Queries on the mapping graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators import graph as g
from tessera.plans.registry import query
from tessera.sources.bindings import Tables

FLAGSHIP = "J1_hub_derivation"

PATHS = """+paths AS (
  SELECT a.title_id, b.title_id AS target_id, b.service AS target_service, a.unit_id, least(a.confidence, b.confidence) AS confidence,
    greatest(a.provenance, b.provenance) AS provenance, b.edge_id
  FROM edges a JOIN edges b ON a.unit_id = b.unit_id AND a.service <> b.service),
best AS (
  SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY title_id, target_id, target_service ORDER BY confidence DESC, provenance DESC, unit_id) = 1)
"""


@query(FLAGSHIP, "titles edges", PATHS + "SELECT title_id, target_service, count(*) AS n_counterparts, max(confidence) AS confidence, max(provenance) AS provenance FROM best GROUP BY 1, 2")
def hub(t: Tables) -> DataFrame:
    return g.links(t.edges(), t.tasks)


@query("J2_derive_all_W9_strongest_path", "titles edges", PATHS + "SELECT title_id, target_id, target_service, confidence, provenance, unit_id FROM best")
def strongest(t: Tables) -> DataFrame:
    return g.strongest_paths(t.edges(), t.tasks)


@query(
    "W10_first_edge_wins",
    "titles edges",
    PATHS + "SELECT title_id, target_id, target_service, edge_id, unit_id, confidence, provenance FROM paths QUALIFY row_number() OVER (PARTITION BY title_id, target_id, target_service ORDER BY edge_id, unit_id) = 1",
)
def first_edge(t: Tables) -> DataFrame:
    return g.first_paths(t.edges(), t.tasks)


ALIASES = "+aliases AS (SELECT DISTINCT group_id AS retired, group_id - 1 AS survivor FROM titles WHERE group_id % 3 = 2)"


def aliases(t: Tables) -> DataFrame:
    return t.titles().where("group_id % 3 = 2").select(F.col("group_id").alias("retired"), (F.col("group_id") - 1).alias("survivor")).distinct()


@query("J3_survivor_resolve", "titles", ALIASES + " SELECT title_id, coalesce(survivor, group_id) AS group_id FROM titles LEFT JOIN aliases ON group_id = retired")
def survivors(t: Tables) -> DataFrame:
    return g.resolve_survivors(t.titles().select("title_id", "group_id"), aliases(t), "group_id")


@query("J4_retired_keys", "titles", ALIASES + " SELECT survivor, list_sort(list(retired)) AS retired FROM aliases GROUP BY survivor")
def retired(t: Tables) -> DataFrame:
    return g.retired_keys(aliases(t))


@query(
    "D11_alias_flattening",
    "titles",
    ALIASES + ", merges AS (SELECT DISTINCT survivor AS retired, survivor - 1 AS survivor FROM aliases WHERE survivor % 2 = 0) "
    "SELECT a.retired, coalesce(m.survivor, a.survivor) AS survivor FROM aliases a LEFT JOIN merges m ON a.survivor = m.retired UNION ALL SELECT retired, survivor FROM merges",
)
def flattened(t: Tables) -> DataFrame:
    a = aliases(t)
    merges = a.where("survivor % 2 = 0").select(F.col("survivor").alias("retired"), (F.col("survivor") - 1).alias("survivor")).distinct()
    return g.flatten_aliases(a, merges)


SEGMENTS = "+segments AS (SELECT title_id, CAST(floor(title_id / 5) AS BIGINT) AS continuity_id FROM titles)"


def segments(t: Tables) -> DataFrame:
    return t.titles().select("title_id", F.floor(F.col("title_id") / 5).cast("long").alias("continuity_id"))


@query("J5_group_continuity", "titles", SEGMENTS + " SELECT group_id, min(continuity_id) AS continuity_id FROM segments JOIN titles USING (title_id) GROUP BY 1")
def continuities(t: Tables) -> DataFrame:
    return g.group_continuities(segments(t), t.titles())


GROUP_SOURCES = "groups AS (SELECT DISTINCT group_id, CASE group_id % 4 WHEN 0 THEN 'release' WHEN 1 THEN 't3-episode' WHEN 2 THEN 'manual' ELSE 'bootstrap' END AS source FROM titles)"


def group_sources(t: Tables) -> DataFrame:
    m = F.col("group_id") % 4
    return t.titles().select("group_id", F.when(m == 0, "release").when(m == 1, "t3-episode").when(m == 2, "manual").otherwise("bootstrap").alias("source")).distinct()


@query(
    "J6_title_evidence",
    "titles",
    f"+{GROUP_SOURCES}, " + """pairs AS (SELECT x.group_id, x.title_id AS a, y.title_id AS b FROM titles x JOIN titles y ON x.group_id = y.group_id AND y.title_id = x.title_id + 1),
said AS (SELECT title_id AS a, title_id + 1 AS b, CASE WHEN ordinal % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, 'community' AS source FROM titles WHERE title_id % 3 = 0)
SELECT p.a, p.b, coalesce(s.confidence, 'low') AS confidence, CASE WHEN s.source IS NULL AND g.source = 'release' THEN NULL ELSE coalesce(s.source, g.source) END AS source
FROM pairs p JOIN groups g USING (group_id) LEFT JOIN said s ON s.a = p.a AND s.b = p.b""",
)
def evidence(t: Tables) -> DataFrame:
    x = t.titles()
    pairs = x.select("group_id", F.col("title_id").alias("a"), (F.col("title_id") + 1).alias("b")).join(x.select("group_id", F.col("title_id").alias("b")), ["group_id", "b"])
    said = x.where("title_id % 3 = 0").select(
        F.col("title_id").alias("a"), (F.col("title_id") + 1).alias("b"), F.when(F.col("ordinal") % 2 == 0, "high").otherwise("low").alias("confidence"), F.lit("community").alias("source")
    )
    return g.title_evidence(pairs, said, group_sources(t))


@query(
    "J7_group_members",
    "titles",
    """SELECT x.group_id, x.title_id, y.title_id AS member_id, y.service AS member_service, CAST(row_number() OVER (PARTITION BY x.title_id ORDER BY y.ordinal, y.title_id) AS INT) AS place
FROM titles x JOIN titles y USING (group_id)""",
)
def members(t: Tables) -> DataFrame:
    return g.members_in_order(t.titles())


RECONCILE = """+u AS (SELECT title_id, unit_id % 500 AS unit_id FROM edges GROUP BY ALL),
pairs AS (SELECT DISTINCT a.title_id, b.title_id AS member_id FROM titles a JOIN titles b ON a.group_id = b.group_id AND a.title_id <> b.title_id),
need AS (SELECT title_id, count(*) AS n FROM u GROUP BY 1),
shared AS (SELECT p.title_id, p.member_id, count(*) AS n, min(x.unit_id) AS unit FROM pairs p JOIN u x ON x.title_id = p.title_id JOIN u y ON y.title_id = p.member_id AND y.unit_id = x.unit_id GROUP BY 1, 2),
c AS (SELECT p.*, coalesce(a.n, 0) AS n_requested, coalesce(b.n, 0) AS n_member, coalesce(s.n, 0) AS n_shared, unit FROM pairs p
  LEFT JOIN need a ON a.title_id = p.title_id LEFT JOIN need b ON b.title_id = p.member_id LEFT JOIN shared s ON s.title_id = p.title_id AND s.member_id = p.member_id),
d AS (SELECT *, CASE WHEN n_requested > 0 AND n_shared = n_requested AND n_member > n_shared THEN 'member'
  WHEN (n_requested > 0 AND n_shared = n_requested) OR n_shared = 0 THEN 'bare' ELSE 'supporting' END AS shape FROM c)
SELECT title_id, member_id, n_requested, n_member, n_shared, shape, CASE WHEN shape <> 'bare' THEN unit END AS shown_unit FROM d"""


@query("J8_coverage_reconcile", "titles edges", RECONCILE)
def reconcile(t: Tables) -> DataFrame:
    u = t.edges().select("title_id", (F.col("unit_id") % 500).alias("unit_id")).distinct()
    x = t.titles().select("group_id", "title_id")
    pairs = x.join(x.withColumnRenamed("title_id", "member_id"), "group_id").where("title_id <> member_id").select("title_id", "member_id").distinct()
    return g.reconcile(u, u, pairs)


@query(
    "J9_best_aligned_A9_shared_units",
    "titles edges",
    """+seg AS (SELECT title_id % 97 AS segment_id, unit_id FROM edges GROUP BY ALL),
mem AS (SELECT e.title_id, e.service, ordinal, unit_id FROM edges e JOIN titles USING (title_id)),
n AS (SELECT segment_id, service, ordinal, title_id, count(*) AS n_shared FROM seg JOIN mem USING (unit_id) GROUP BY ALL)
SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY segment_id, service ORDER BY n_shared DESC, ordinal, title_id) = 1""",
)
def aligned(t: Tables) -> DataFrame:
    e = t.edges("ordinal")
    seg = g.dealt(e.select((F.col("title_id") % 97).alias("segment_id"), "unit_id"), t.tasks, "unit_id").distinct()
    return g.best_aligned(seg, g.dealt(e.select("title_id", "service", "ordinal", "unit_id"), t.tasks, "unit_id"), t.tasks)


STATES = """coverage AS (
  SELECT title_id AS id, group_id, service, CASE ordinal % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'open' WHEN 2 THEN 'pending' ELSE 'conflict' END AS state FROM titles)"""
VERDICTS = f"+{STATES}, " + """v AS (SELECT group_id, service, bool_or(state IN ('complete', 'open')) AS usable, min(CASE WHEN state = 'pending' THEN id END) AS pending_id,
  min(CASE WHEN state = 'conflict' THEN id END) AS conflict_id FROM coverage GROUP BY 1, 2)"""


def coverage(t: Tables) -> DataFrame:
    m = F.col("ordinal") % 4
    return t.titles().select(F.col("title_id").alias("id"), "group_id", "service", F.when(m == 0, "complete").when(m == 1, "open").when(m == 2, "pending").otherwise("conflict").alias("state"))


@query("A5_coverage_verdict", "titles", VERDICTS + " SELECT * FROM v")
def verdicts(t: Tables) -> DataFrame:
    return g.coverage_verdicts(coverage(t))


@query(
    "R3_completion",
    "titles",
    VERDICTS + " SELECT group_id, service, CASE WHEN usable THEN 'known-no-counterpart' WHEN pending_id IS NOT NULL THEN 'pending' WHEN conflict_id IS NOT NULL THEN 'conflict' END AS status FROM v",
)
def completions(t: Tables) -> DataFrame:
    v = g.coverage_verdicts(coverage(t))
    return v.select("group_id", "service", scores.completion(F.col("usable"), F.col("pending_id"), F.col("conflict_id")).alias("status"))


@query(
    "R4_request_outcome",
    "titles",
    VERDICTS + """, s AS (SELECT group_id, CASE WHEN usable THEN 'known-no-counterpart' WHEN pending_id IS NOT NULL THEN 'pending' ELSE 'conflict' END AS status FROM v)
SELECT group_id, CASE WHEN bool_or(status IN ('matched', 'known-no-counterpart')) THEN 'ok' WHEN bool_or(status = 'pending') THEN 'pending' WHEN bool_or(status = 'conflict') THEN 'conflict' ELSE 'ok' END AS outcome
FROM s GROUP BY 1""",
)
def outcomes(t: Tables) -> DataFrame:
    v = g.coverage_verdicts(coverage(t)).withColumn("status", scores.completion(F.col("usable"), F.col("pending_id"), F.col("conflict_id")))
    any_ = lambda *s: F.bool_or(F.col("status").isin(*s))
    return v.groupBy("group_id").agg(
        F.when(any_("matched", "known-no-counterpart"), "ok").when(any_("pending"), "pending").when(any_("conflict"), "conflict").otherwise("ok").alias("outcome")
    )


@query(
    "A12_media_kind",
    "anidb",
    """SELECT CAST(floor(title_id / 2) AS BIGINT) AS group_id,
  CASE WHEN bool_or(service IN ('anidb', 'anilist', 'kitsu', 'mal')) THEN 'anime' WHEN bool_or(service = 'tmdb' AND native LIKE 'tv:%') THEN 'tv' ELSE 'film' END AS media_kind
FROM anidb GROUP BY 1""",
)
def kinds(t: Tables) -> DataFrame:
    return g.media_kind(t.titles_with_anidb().withColumn("group_id", F.floor(F.col("title_id") / 2).cast("long")))


@query(
    "X30_spine_titles",
    "anidb",
    """+r AS (SELECT *, CASE WHEN service = 'anidb' THEN 0 WHEN service IN ('anilist', 'kitsu', 'mal') THEN 1 WHEN service = 'tmdb' THEN 2 END AS r FROM anidb),
b AS (SELECT *, min(r) OVER (PARTITION BY group_id) AS best FROM r WHERE r IS NOT NULL)
SELECT group_id, title_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY ordinal, title_id) AS INT) AS place FROM b WHERE r = best""",
)
def spines(t: Tables) -> DataFrame:
    return g.spine(t.titles_with_anidb())


RANKS = "list_position(['bootstrap', 't1-structure', 't2-pattern', 't3-episode', 'llm-research', 'llm-verified', 'community', 'manual'], {0}) - 1"


@query(
    "A8_group_source",
    "titles",
    f"+{GROUP_SOURCES}, " + f"x AS (SELECT CAST(floor(group_id / 3) AS BIGINT) AS zone, source, CASE WHEN source = 'release' THEN -1 ELSE {RANKS.format('source')} END AS r FROM groups) SELECT zone, arg_max(source, r) AS source FROM x GROUP BY 1",
)
def sources(t: Tables) -> DataFrame:
    return g.most_curated(group_sources(t).select(F.floor(F.col("group_id") / 3).cast("long").alias("zone"), "source"), ["zone"])


@query(
    "A7_compact_link",
    "titles",
    VERDICTS + """, s AS (SELECT group_id, CASE WHEN usable THEN 0 WHEN pending_id IS NOT NULL THEN 2 ELSE 3 END AS r, service FROM v)
SELECT group_id, count(*) AS n_links, arg_max(CASE r WHEN 0 THEN 'known-no-counterpart' WHEN 2 THEN 'pending' ELSE 'conflict' END, r) AS status FROM s GROUP BY 1""",
)
def compact(t: Tables) -> DataFrame:
    v = g.coverage_verdicts(coverage(t)).withColumn("status", scores.completion(F.col("usable"), F.col("pending_id"), F.col("conflict_id")))
    return v.groupBy("group_id").agg(F.count("*").alias("n_links"), F.max_by("status", scores.link_rank(F.col("status"))).alias("status"))


@query(
    "J30_competing_coverage",
    "titles edges",
    """+held AS (SELECT title_id AS instalment_id, unit_id % 40 AS unit_id FROM edges WHERE provenance > 2 GROUP BY ALL),
prop AS (SELECT title_id AS instalment_id, unit_id % 40 AS unit_id FROM edges WHERE provenance = 1 GROUP BY ALL)
SELECT p.instalment_id, p.unit_id, h.unit_id AS held_unit_id FROM prop p JOIN held h ON p.instalment_id = h.instalment_id AND p.unit_id <> h.unit_id""",
)
def competing(t: Tables) -> DataFrame:
    e = t.edges().select(F.col("title_id").alias("instalment_id"), (F.col("unit_id") % 40).alias("unit_id"), "provenance")
    return g.competing(e.where("provenance > 2").drop("provenance").distinct(), e.where("provenance = 1").drop("provenance").distinct())


@query(
    "J29_endpoint_conflicts",
    "titles",
    """+prop AS (SELECT title_id AS from_id, title_id + 1 AS to_id FROM titles WHERE title_id % 2 = 0),
pub AS (SELECT title_id AS from_id, title_id + 1 + ordinal % 2 AS to_id FROM titles WHERE title_id % 3 = 0)
SELECT DISTINCT p.from_id, p.to_id, q.from_id AS held_from, q.to_id AS held_to FROM prop p JOIN pub q ON (p.from_id = q.from_id AND p.to_id <> q.to_id) OR (p.to_id = q.to_id AND p.from_id <> q.from_id)""",
)
def endpoints(t: Tables) -> DataFrame:
    x = t.titles()
    prop = x.where("title_id % 2 = 0").select(F.col("title_id").alias("from_id"), (F.col("title_id") + 1).alias("to_id"))
    pub = x.where("title_id % 3 = 0").select(F.col("title_id").alias("from_id"), (F.col("title_id") + 1 + F.col("ordinal") % 2).alias("to_id"))
    return g.endpoint_conflicts(prop, pub)


@query(
    "J20_same_members",
    "titles",
    """+e AS (SELECT group_id AS set_id, title_id AS member FROM titles), a AS (SELECT group_id AS set_id, title_id AS member FROM titles WHERE NOT (group_id % 2 = 0 AND ordinal % 9 = 0))
SELECT set_id, count(*) FILTER (WHERE x IS NULL OR y IS NULL) = 0 AS same FROM (SELECT *, 1 AS x FROM e) FULL JOIN (SELECT *, 1 AS y FROM a) USING (set_id, member) GROUP BY 1""",
)
def same(t: Tables) -> DataFrame:
    e = t.titles().select(F.col("group_id").alias("set_id"), F.col("title_id").alias("member"), "ordinal")
    return g.same_members(e.drop("ordinal"), e.where(~((F.col("set_id") % 2 == 0) & (F.col("ordinal") % 9 == 0))).drop("ordinal"))


@query(
    "J16_assertions_within_group_J28_semi_join",
    "titles",
    """+said AS (SELECT title_id AS a, title_id + ordinal % 5 AS b FROM titles), inside AS (SELECT title_id FROM titles WHERE group_id % 7 = 0)
SELECT a, b FROM said WHERE a IN (SELECT title_id FROM inside) AND b IN (SELECT title_id FROM inside)""",
)
def within(t: Tables) -> DataFrame:
    x = t.titles()
    said = x.select(F.col("title_id").alias("a"), (F.col("title_id") + F.col("ordinal") % 5).alias("b"))
    inside = x.where("group_id % 7 = 0").select("title_id")
    return said.join(inside, F.col("a") == F.col("title_id"), "left_semi").join(inside, F.col("b") == F.col("title_id"), "left_semi")


@query(
    "R7_continuity_locators",
    "titles",
    """+seg AS (SELECT CAST(floor(title_id / 5) AS BIGINT) AS continuity_id, service, native, ordinal % 4 AS n FROM titles)
SELECT continuity_id, service || ':' || native || '#' || p AS locator FROM seg, unnest(range(1, n + 1)) u(p) WHERE n > 0""",
)
def locators(t: Tables) -> DataFrame:
    seg = t.titles().select(F.floor(F.col("title_id") / 5).cast("long").alias("continuity_id"), "service", "native", (F.col("ordinal") % 4).alias("n")).where("n > 0")
    return seg.select("continuity_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("p"), "service", "native").select(
        "continuity_id", F.concat("service", F.lit(":"), "native", F.lit("#"), F.col("p").cast("string")).alias("locator")
    )
