"""Queries on plans, hits, candidates, pairings, budgets and blocking conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scores import anilist_status, mal_status
from tessera.operators import publication as p
from tessera.operators.graph import ranked
from tessera.plans.graph import ALIASES, aliases
from tessera.plans.registry import query
from tessera.sources.bindings import Tables


def case(c, *values):
    """values by the remainder of c."""
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


@query(
    "F5_target_plans",
    "titles",
    """+x AS (SELECT title_id, service, list_extract(['anime', 'movie', 'series'], CAST(title_id % 3 + 1 AS INT)) AS profile FROM titles)
SELECT title_id, 'enumerated' AS kind, target FROM x, (VALUES ('anilist'), ('mal')) v(target) WHERE profile = 'anime' AND service <> 'tmdb' AND service <> target
UNION ALL SELECT title_id, 'atomic', CASE service WHEN 'tmdb' THEN 'imdb' ELSE 'tmdb' END FROM x WHERE profile <> 'anime' AND service IN ('tmdb', 'imdb')""",
)
def targets(t: Tables) -> DataFrame:
    return p.target_plans(t.titles().select("title_id", "service", case(F.col("title_id"), "anime", "movie", "series").alias("profile")))


@query(
    "J18_new_hits",
    "titles",
    """+hits AS (SELECT group_id, title_id + ordinal % 9 AS ref, ordinal / 50.0 AS score FROM titles UNION ALL SELECT group_id, title_id + 8, title_id % 10 / 10.0 FROM titles)
SELECT group_id, ref, CAST(max(score) AS DOUBLE) AS score FROM hits h WHERE NOT EXISTS (SELECT 1 FROM titles m WHERE m.group_id = h.group_id AND m.title_id = h.ref) GROUP BY 1, 2""",
)
def hits(t: Tables) -> DataFrame:
    x = t.titles()
    found = x.select("group_id", (F.col("title_id") + F.col("ordinal") % 9).alias("ref"), (F.col("ordinal") / 50.0).alias("score")).unionByName(
        x.select("group_id", (F.col("title_id") + 8).alias("ref"), (F.col("title_id") % 10 / 10.0).alias("score"))
    )
    return p.new_hits(found, x.select("group_id", F.col("title_id").alias("ref")))


SIMILAR = "items AS (SELECT group_id // 2 AS host, title_id AS pos, title_id * 7 % 2500 AS ref FROM titles), known AS (SELECT title_id AS ref, group_id // 2 AS c FROM titles WHERE group_id % 5 <> 0)"


@query(
    "J22_similar_works",
    "titles",
    f"+{SIMILAR}, " + """named AS (SELECT host, pos, coalesce('continuity:' || c, 'title:' || ref) AS work FROM items LEFT JOIN known USING (ref) WHERE c IS NULL OR c <> host),
one AS (SELECT host, work, min(pos) AS pos FROM named GROUP BY 1, 2)
SELECT host, work, row_number() OVER (PARTITION BY host ORDER BY pos) - 1 AS place FROM one""",
)
def similar(t: Tables) -> DataFrame:
    x = t.titles()
    items = x.select(F.floor(F.col("group_id") / 2).alias("host"), F.col("title_id").alias("pos"), (F.col("title_id") * 7 % 2500).alias("ref"))
    return p.similar_works(items, x, x.where("group_id % 5 <> 0").select("group_id", F.floor(F.col("group_id") / 2).alias("continuity_id")).distinct())


@query(
    "J21_hits_to_continuities",
    "titles",
    """+hits AS (SELECT title_id AS hit_id, title_id * 3 % 2600 AS ref FROM titles), known AS (SELECT DISTINCT group_id, group_id // 2 AS continuity_id FROM titles WHERE group_id % 5 <> 0)
SELECT hit_id, group_id, continuity_id FROM hits LEFT JOIN titles ON title_id = ref LEFT JOIN known USING (group_id)""",
)
def hit_works(t: Tables) -> DataFrame:
    x = t.titles()
    known = x.where("group_id % 5 <> 0").select("group_id", F.floor(F.col("group_id") / 2).alias("continuity_id")).distinct()
    found = x.select(F.col("title_id").alias("hit_id"), (F.col("title_id") * 3 % 2600).alias("ref")).join(x.select(F.col("title_id").alias("ref"), "group_id"), "ref", "left")
    return found.join(known, "group_id", "left").select("hit_id", "group_id", "continuity_id")


@query(
    "J26_presented_items_O9_order_slug",
    "works",
    """+orders AS (SELECT work_id, 'release' AS slug FROM works UNION SELECT work_id, 'watch' FROM works WHERE work_id % 2 = 0),
wanted AS (SELECT DISTINCT work_id, CASE work_id % 3 WHEN 0 THEN 'watch' WHEN 1 THEN 'release' END AS wanted FROM works),
chosen AS (SELECT work_id, CASE WHEN EXISTS (SELECT 1 FROM orders o WHERE o.work_id = w.work_id AND slug = wanted) THEN wanted
  WHEN EXISTS (SELECT 1 FROM orders o WHERE o.work_id = w.work_id AND slug = 'watch') THEN 'watch' ELSE 'release' END AS slug FROM wanted w)
SELECT work_id, slug, CASE slug WHEN 'watch' THEN 4 - pos ELSE pos END AS position, locator FROM chosen JOIN works USING (work_id)""",
)
def presented(t: Tables) -> DataFrame:
    w, n = t.works(), F.col("work_id")
    rows = w.select(n.alias("continuity_id"), F.lit("release").alias("slug"), F.col("pos").alias("position"), "locator").unionByName(
        w.where("work_id % 2 = 0").select(n.alias("continuity_id"), F.lit("watch").alias("slug"), (4 - F.col("pos")).alias("position"), "locator")
    )
    wanted = w.select(n.alias("continuity_id"), F.when(n % 3 == 0, "watch").when(n % 3 == 1, "release").alias("wanted")).distinct()
    chosen = p.chosen_order(rows.select("continuity_id", "slug").distinct(), wanted)
    return rows.join(chosen, ["continuity_id", "slug"]).withColumnRenamed("continuity_id", "work_id")


HELD = "held AS (SELECT edge_id, title_id, group_id, unit_id, CASE provenance WHEN 1 THEN 'bootstrap' WHEN 2 THEN 'llm-research' ELSE 'community' END AS source FROM edges JOIN titles USING (title_id))"


def held(t: Tables) -> DataFrame:
    n = F.col("provenance")
    source = F.when(n == 1, "bootstrap").when(n == 2, "llm-research").otherwise("community")
    return t.edges().join(t.titles().select("title_id", "group_id"), "title_id").select("edge_id", "title_id", "group_id", "unit_id", source.alias("source"))


@query(
    "J27_T5w_bootstrap_retired",
    "titles edges",
    f"+{HELD} SELECT group_id, source, count(*) AS n FROM held WHERE NOT (source = 'bootstrap' AND group_id % 2 = 0) GROUP BY 1, 2",
)
def bootstrap(t: Tables) -> DataFrame:
    left = p.retire_bootstrap(held(t), t.titles().where("group_id % 2 = 0").select("group_id").distinct())
    return left.groupBy("group_id", "source").agg(F.count("*").alias("n"))


@query(
    "T20w_unit_choice",
    "titles edges",
    f"+{HELD}, " + """asked AS (SELECT title_id, CASE WHEN title_id % 5 = 0 THEN title_id * 10 END AS given FROM titles),
prior AS (SELECT title_id, unit_id, source FROM held WHERE title_id % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY title_id ORDER BY source <> 'llm-research', edge_id) = 1)
SELECT title_id AS instalment_id, coalesce(given, unit_id) AS unit_id, CASE WHEN given IS NOT NULL THEN 'given' WHEN source IS NULL THEN 'new' WHEN source = 'llm-research' THEN 'research' ELSE 'held' END AS origin
FROM asked LEFT JOIN prior USING (title_id)""",
)
def unit_choice(t: Tables) -> DataFrame:
    asked = t.titles().select(F.col("title_id").alias("instalment_id"), F.when(F.col("title_id") % 5 == 0, F.col("title_id") * 10).alias("unit_id"))
    return p.chosen_units(asked, held(t).where("title_id % 4 <> 1").withColumnRenamed("title_id", "instalment_id"))


@query(
    "A20_D12_coverage_after_merge",
    "titles",
    ALIASES + """, coverage AS (SELECT group_id, service, max(ordinal) AS revision, 'complete' AS state FROM titles GROUP BY 1, 2),
moved AS (SELECT group_id, survivor FROM coverage JOIN aliases ON group_id = retired UNION SELECT survivor, survivor FROM aliases)
SELECT * FROM coverage WHERE group_id NOT IN (SELECT retired FROM aliases)
UNION ALL SELECT survivor, service, max(revision) + 1, 'pending' FROM coverage JOIN moved USING (group_id) GROUP BY 1, 2""",
)
def merged_coverage(t: Tables) -> DataFrame:
    coverage = t.titles().groupBy("group_id", "service").agg(F.max("ordinal").alias("revision")).withColumn("state", F.lit("complete"))
    return p.coverage_after_merge(coverage, aliases(t))


@query(
    "A24_candidates_once",
    "titles",
    """+c AS (SELECT group_id, title_id AS pos, title_id // 3 % 4 AS ref FROM titles WHERE title_id // 3 % 4 <> group_id % 4), one AS (SELECT group_id, ref, min(pos) AS pos FROM c GROUP BY 1, 2)
SELECT group_id, ref, row_number() OVER (PARTITION BY group_id ORDER BY pos) - 1 AS place FROM one""",
)
def candidates(t: Tables) -> DataFrame:
    c = t.titles().select("group_id", F.col("title_id").alias("pos"), (F.floor(F.col("title_id") / 3) % 4).alias("ref")).where("ref <> group_id % 4")
    return p.firsts_in_order(c, "group_id", "ref", ["pos"]).select("group_id", "ref", "place")


@query(
    "W6_adjacent_pairs",
    "stream",
    "SELECT a.pair_id, a.side, a.locator AS earlier, b.locator AS later FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY pos) AS n FROM stream) a "
    "JOIN (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY pos) AS n FROM stream) b ON a.pair_id = b.pair_id AND a.side = b.side AND b.n = a.n + 1",
)
def adjacent(t: Tables) -> DataFrame:
    w = Window.partitionBy("pair_id", "side").orderBy("pos")
    return t.stream().select("pair_id", "side", F.col("locator").alias("earlier"), F.lead("locator").over(w).alias("later")).where("later IS NOT NULL")


@query(
    "W17_next_ordinals",
    "titles",
    """+top AS (SELECT group_id, max(ordinal) AS m FROM titles WHERE title_id % 3 <> 0 GROUP BY 1)
SELECT title_id, coalesce(m, -1) + row_number() OVER (PARTITION BY group_id ORDER BY title_id) AS ordinal FROM titles LEFT JOIN top USING (group_id) WHERE title_id % 3 = 0""",
)
def next_ordinals(t: Tables) -> DataFrame:
    top = t.titles().where("title_id % 3 <> 0").groupBy("group_id").agg(F.max("ordinal").alias("_m"))
    new = ranked(t.titles().where("title_id % 3 = 0").join(top, "group_id", "left"), ["group_id"], ["title_id"])
    return new.select("title_id", (F.coalesce("_m", F.lit(-1)) + F.col("_rank")).cast("long").alias("ordinal"))


@query(
    "O5_counterpart_order",
    "titles",
    "SELECT group_id, title_id, row_number() OVER (PARTITION BY group_id ORDER BY native, ordinal % 4, ordinal, title_id) AS place FROM titles",
)
def counterpart_order(t: Tables) -> DataFrame:
    return ranked(t.titles(), ["group_id"], ["native", F.col("ordinal") % 4, "ordinal", "title_id"], "place").select("group_id", "title_id", "place")


@query("O6_review_queue", "ev", "SELECT event_id, ts AS created_at FROM ev WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100")
def review_queue(t: Tables) -> DataFrame:
    """The first hundred open rows; the limit is the report's."""
    return t.events().where("event_type = 'error'").select("event_id", F.col("ts").alias("created_at")).orderBy("created_at", "event_id").limit(100)


@query("O10_lowest_subject", "titles", "SELECT group_id, min(title_id) AS title_id FROM titles GROUP BY 1")
def subject(t: Tables) -> DataFrame:
    return t.titles().groupBy("group_id").agg(F.min("title_id").alias("title_id"))


@query(
    "U3_remaining_shared",
    "stream",
    "SELECT pair_id, pos, locator FROM stream l WHERE side = 'left' AND NOT EXISTS (SELECT 1 FROM stream r WHERE r.side = 'right' AND r.pair_id = l.pair_id AND r.locator = l.locator)",
)
def remaining(t: Tables) -> DataFrame:
    claimed = t.stream().where("side = 'right'").select("pair_id", "locator")
    return t.stream().where("side = 'left'").join(claimed, ["pair_id", "locator"], "left_anti").select("pair_id", "pos", "locator")


@query(
    "U4_merged_residue",
    "titles",
    """+listed AS (SELECT group_id, list(service ORDER BY title_id) AS targets, coalesce(list(service ORDER BY title_id) FILTER (WHERE ordinal % 3 = 0), []) AS residue,
  coalesce(list(service ORDER BY title_id) FILTER (WHERE ordinal % 3 = 1), []) AS resolved FROM titles GROUP BY 1),
said AS (SELECT group_id, unnest(residue) AS service, unnest(range(len(residue))) AS pos FROM listed
  UNION ALL SELECT group_id, service, pos + 1000 FROM (SELECT group_id, residue, resolved, unnest(targets) AS service, unnest(range(len(targets))) AS pos FROM listed) WHERE NOT list_contains(residue, service) AND NOT list_contains(resolved, service)),
one AS (SELECT group_id, service, min(pos) AS pos FROM said GROUP BY 1, 2)
SELECT group_id, service, CAST(row_number() OVER (PARTITION BY group_id ORDER BY pos) - 1 AS INT) AS place FROM one""",
)
def residue(t: Tables) -> DataFrame:
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("title_id", "service")))), lambda x: x["service"])
    m = F.col("ordinal") % 3
    g = t.titles().groupBy("group_id").agg(listed(F.lit(True)).alias("targets"), listed(m == 0).alias("residue"), listed(m == 1).alias("resolved"))
    return g.select("group_id", F.posexplode(p.merged_residue(F.col("targets"), F.col("residue"), F.col("resolved"))).alias("place", "service"))


@query(
    "U5_merged_facts",
    "stream",
    """SELECT pair_id, locator, CASE WHEN r.pair_id IS NULL THEN l.title ELSE r.title END AS title, CASE WHEN r.pair_id IS NULL THEN l.runtime ELSE r.runtime END AS runtime
FROM (SELECT * FROM stream WHERE side = 'left') l FULL JOIN (SELECT * FROM stream WHERE side = 'right') r USING (pair_id, locator)""".replace(
        "r.pair_id IS NULL", "r.side IS NULL"
    ),
)
def facts(t: Tables) -> DataFrame:
    s = t.stream().select("pair_id", "locator", (F.col("side") == "right").cast("int").alias("n"), "title", "runtime")
    return p.later_wins(s, ["pair_id", "locator"], "n")


@query(
    "X16_imported_status",
    "ev",
    """SELECT event_id, CASE k % 8 WHEN 0 THEN 'watching' WHEN 1 THEN 'completed' WHEN 2 THEN 'on_hold' WHEN 3 THEN 'dropped' WHEN 4 THEN 'rewatching' WHEN 5 THEN 'plan_to_watch' END AS mal,
  CASE k % 8 WHEN 0 THEN 'watching' WHEN 1 THEN 'completed' WHEN 2 THEN 'on_hold' WHEN 3 THEN 'dropped' WHEN 4 THEN 'rewatching' WHEN 5 THEN 'plan_to_watch' END AS anilist FROM ev""",
)
def imported_status(t: Tables) -> DataFrame:
    k = F.col("k")
    mal = case(k, "watching", "completed", "on_hold", "dropped", "rewatching", "plan_to_watch", "reading", "")
    anilist = case(k, "CURRENT", "COMPLETED", "PAUSED", "DROPPED", "REPEATING", "PLANNING", "READING", "")
    return t.events().select("event_id", mal_status(mal).alias("mal"), anilist_status(anilist).alias("anilist"))


KEYS = """keys AS (SELECT event_id, CAST(floor(k / 5) AS BIGINT) AS n, CASE event_id % 4 WHEN 0 THEN 'continuity:' || CAST(floor(k / 5) AS BIGINT) WHEN 1 THEN 'part:continuity:' || CAST(floor(k / 5) AS BIGINT) || ':2' WHEN 2 THEN 'w#' || k ELSE 'part:continuity:x:1' END AS unit_key, event_id % 4 AS form FROM ev)"""


@query(
    "X24_canonical_key_F11_rating_owner",
    "ev works",
    f"+{KEYS}, " + """moved AS (SELECT event_id, unit_key, CASE WHEN form < 2 AND n % 3 = 1 THEN n - 1 ELSE n END AS to_, form, n FROM keys),
named AS (SELECT event_id, unit_key, CASE form WHEN 0 THEN 'continuity:' || to_ WHEN 1 THEN 'part:continuity:' || to_ || ':2' ELSE unit_key END AS canonical, to_, form FROM moved)
SELECT event_id, canonical, CASE WHEN form < 2 THEN to_ WHEN form = 2 THEN w.work_id END AS work_id FROM named LEFT JOIN works w ON form = 2 AND w.locator = unit_key""",
)
def canonical(t: Tables) -> DataFrame:
    n = F.floor(F.col("k") / 5).cast("string")
    form = F.col("event_id") % 4
    key = F.when(form == 0, F.concat(F.lit("continuity:"), n)).when(form == 1, F.concat(F.lit("part:continuity:"), n, F.lit(":2"))).when(form == 2, F.concat(F.lit("w#"), F.col("k").cast("string"))).otherwise("part:continuity:x:1")
    old = t.spark.range(200).where("id % 3 = 1").select(F.col("id").alias("retired"), (F.col("id") - 1).alias("survivor"))
    named = p.canonical_key(t.events().select("event_id", key.alias("unit_key")), old)
    work = F.regexp_extract("canonical", "^(?:part:)?continuity:([0-9]+)", 1).try_cast("long")
    owner = t.works().select(F.col("locator").alias("canonical"), "work_id")
    return named.join(owner, "canonical", "left").select("event_id", "canonical", F.coalesce(work, "work_id").alias("work_id"))


@query(
    "X25_catalogue_links",
    "titles",
    """+seen AS (SELECT group_id, service, title_id // 2 AS id, min(title_id) AS pos FROM titles GROUP BY 1, 2, 3)
SELECT group_id, service, id, CASE WHEN count(*) OVER (PARTITION BY group_id, service) > 1 THEN service || ' · Part ' || (pos % 8 + 1) ELSE service END AS label FROM seen""",
)
def catalogue_links(t: Tables) -> DataFrame:
    seen = t.titles().groupBy("group_id", "service", F.floor(F.col("title_id") / 2).alias("id")).agg(F.min("title_id").alias("pos"))
    many = F.count("*").over(Window.partitionBy("group_id", "service")) > 1
    label = F.when(many, F.concat("service", F.lit(" · Part "), (F.col("pos") % 8 + 1).cast("string"))).otherwise(F.col("service"))
    return seen.select("group_id", "service", "id", label.alias("label"))


@query("X26_json_each", "", "SELECT event_id, key, json_extract_string(props, key) AS value, CAST(len(json_keys(props)) AS INT) AS n FROM (SELECT *, unnest(json_keys(props)) AS key FROM events)")
def json_each(t: Tables) -> DataFrame:
    parsed = t.table("events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return parsed.select("event_id", F.size("m").alias("n"), F.explode("m"))


@query(
    "X29_segment_kind",
    "anidb",
    """SELECT title_id, CASE WHEN native LIKE 'movie:%' OR (service IN ('anidb', 'anilist', 'kitsu', 'mal') AND EXISTS (SELECT 1 FROM anidb o WHERE o.group_id = t.group_id AND o.native LIKE 'movie:%')) THEN 'atomic' ELSE 'episodic' END AS kind FROM anidb t""",
)
def kinds(t: Tables) -> DataFrame:
    return p.segment_kinds(t.titles_with_anidb())


@query(
    "M10_budget_ledger",
    "titles",
    """+/*recursive*/ c AS (SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY title_id) AS INT) AS pos, CAST(ordinal AS BIGINT) AS cost FROM titles),
run AS (SELECT group_id, pos, cost, cost <= 60 AS paid, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS spent FROM c WHERE pos = 1
  UNION ALL SELECT c.group_id, c.pos, c.cost, spent + c.cost <= 60, CASE WHEN spent + c.cost <= 60 THEN spent + c.cost ELSE spent END FROM run JOIN c ON c.group_id = run.group_id AND c.pos = run.pos + 1)
SELECT group_id, pos, cost, paid FROM run""",
)
def budget(t: Tables) -> DataFrame:
    return p.ledger(ranked(t.titles(), ["group_id"], ["title_id"], "pos").select("group_id", "pos", F.col("ordinal").alias("cost")), 60)


@query(
    "R9_publication_blocked_F7",
    "titles edges",
    """+c AS (SELECT title_id AS conflict_id, title_id % 4 AS form FROM titles WHERE title_id % 9 = 0),
refs AS (SELECT conflict_id, 'title' AS kind, conflict_id AS id FROM c WHERE form IN (0, 1) UNION ALL SELECT conflict_id, 'title', conflict_id + 11 FROM c WHERE form IN (0, 1) UNION ALL SELECT conflict_id, 'unit', conflict_id FROM c WHERE form = 2),
scope AS (SELECT group_id, 'title' AS kind, title_id AS id FROM titles UNION SELECT group_id, 'unit', unit_id FROM edges JOIN titles USING (title_id)),
hit AS (SELECT group_id, count(DISTINCT conflict_id) AS n, min(conflict_id) AS f FROM refs JOIN scope USING (kind, id) GROUP BY 1)
SELECT group_id, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_conflicts, f AS first_conflict FROM (SELECT DISTINCT group_id FROM titles) LEFT JOIN hit USING (group_id)""",
)
def blocked(t: Tables) -> DataFrame:
    x = t.titles()
    ref = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("id"))
    named = F.when((F.col("title_id") % 4).isin(0, 1), F.array(ref("title", F.col("title_id")), ref("title", F.col("title_id") + 11))).when(F.col("title_id") % 4 == 2, F.array(ref("unit", F.col("title_id")))).otherwise(F.array().cast("array<struct<kind:string,id:bigint>>"))
    units = t.edges().join(x.select("title_id", "group_id"), "title_id").select("group_id", F.lit("unit").alias("kind"), F.col("unit_id").alias("id")).distinct()
    scope = x.select("group_id", F.lit("title").alias("kind"), F.col("title_id").alias("id")).unionByName(units)
    return p.publication(x.where("title_id % 9 = 0").select(F.col("title_id").alias("conflict_id"), named.alias("refs")), scope, x.select("group_id").distinct())


@query(
    "T17w_pairings",
    "stream",
    """+spokes AS (SELECT row_number() OVER (ORDER BY pair_id, side, pos) AS n, pair_id * 1000 + pos * 2 + CAST(side = 'right' AS INT) AS spoke_id, pair_id, side, pos, locator FROM stream WHERE kind = 'regular')
SELECT l.pair_id * 1000 + l.pos AS pair_no, [l.spoke_id, r.spoke_id] AS spoke_ids FROM spokes l JOIN spokes r ON l.side = 'left' AND r.side = 'right' AND l.pair_id = r.pair_id AND l.locator = r.locator""",
)
def spoke_pairs(t: Tables) -> DataFrame:
    s = t.stream()
    title = F.struct("pair_id", "side").alias("title_id")
    aligned = s.select((F.col("pair_id") * 1000 + F.col("pos")).alias("pair_no"), title, "locator")
    spokes = s.where("kind = 'regular'").select((F.col("pair_id") * 1000 + F.col("pos") * 2 + (F.col("side") == "right").cast("int")).alias("spoke_id"), title, "locator")
    return p.pairings(aligned, spokes)


@query(
    "T22w_entitled_T23w_verified",
    "",
    """WITH e AS (SELECT c_custkey AS user_id, c_mktsegment = 'BUILDING' AS active FROM customer), k AS (SELECT c_custkey AS user_id, sha256('key-' || c_custkey) AS key_hash, c_custkey % 6 = 0 AS revoked FROM customer),
asked AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, CASE WHEN o_orderkey % 7 = 0 THEN 'wrong' ELSE 'key-' || o_custkey END AS secret FROM orders)
SELECT request_id, a.user_id, coalesce(active, false) AS entitled FROM asked a JOIN k ON sha256(secret) = key_hash AND NOT revoked LEFT JOIN e ON e.user_id = a.user_id""",
)
def verified(t: Tables) -> DataFrame:
    c, u = t.table("customer"), F.col("c_custkey")
    keys = c.where(u % 6 != 0).select(F.sha2(F.concat(F.lit("key-"), u.cast("string")), 256).alias("key_hash"))
    active = c.select(u.alias("user_id"), (F.col("c_mktsegment") == "BUILDING").alias("active"))
    secret = F.when(F.col("o_orderkey") % 7 == 0, "wrong").otherwise(F.concat(F.lit("key-"), F.col("o_custkey").cast("string")))
    asked = t.table("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.sha2(secret, 256).alias("key_hash"))
    return asked.join(keys, "key_hash", "left_semi").join(active, "user_id", "left").select("request_id", "user_id", F.coalesce("active", F.lit(False)).alias("entitled"))


@query(
    "D2_broker_outcome",
    "titles",
    """SELECT title_id, CASE WHEN title_id % 13 = 0 THEN 'unconfigured' WHEN service = 'tvdb' THEN 'unsupported-id' WHEN title_id % 5 = 0 THEN 'request-failed' WHEN title_id % 7 = 0 THEN 'no-record' ELSE 'brokered' END AS outcome FROM titles""",
)
def broker(t: Tables) -> DataFrame:
    outcome = (
        F.when(F.col("title_id") % 13 == 0, "unconfigured").when(F.col("service") == "tvdb", "unsupported-id").when(F.col("title_id") % 5 == 0, "request-failed").when(F.col("title_id") % 7 == 0, "no-record").otherwise("brokered")
    )
    return t.titles().select("title_id", outcome.alias("outcome"))


@query(
    "X21_evidence_hash",
    "titles",
    """SELECT group_id, 'fuzzy-group:[' || string_agg('{"service":"' || service || '","serviceId":"' || native || '"}', ',' ORDER BY service, native) || ']' AS evidence_hash FROM titles GROUP BY 1""",
)
def hashes(t: Tables) -> DataFrame:
    return p.evidence_hash("fuzzy-group", t.titles().select("group_id", "service", F.col("native").alias("serviceId")), "group_id")


@query(
    "T8w_decisions",
    "ev",
    """+d AS (SELECT k % 40 AS candidate_id, event_type = 'click' AS yes, ts, event_id FROM ev WHERE event_type IN ('click', 'purchase') AND value > 90),
f AS (SELECT candidate_id, yes FROM d QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY ts, event_id) = 1)
SELECT c AS candidate_id, CASE WHEN yes IS NULL THEN 'open' WHEN yes THEN 'accepted' ELSE 'rejected' END AS status FROM range(50) r(c) LEFT JOIN f ON candidate_id = c""",
)
def decided(t: Tables) -> DataFrame:
    verdict = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "purchase", "rejected").otherwise("kept")
    d = t.events().where("value > 90").select((F.col("k") % 40).cast("long").alias("candidate_id"), verdict.alias("verdict"), F.col("ts").alias("at"), F.col("event_id").alias("decision_id"))
    return p.settled(t.spark.range(50).select(F.col("id").alias("candidate_id")), d)


@query(
    "T10w_recheck",
    "titles",
    """+/*recursive*/ c AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY title_id) AS pos FROM titles),
run AS (SELECT group_id, title_id, pos, ordinal <= 70 AS paid, CASE WHEN ordinal <= 70 THEN ordinal ELSE 0 END AS spent FROM c WHERE pos = 1
  UNION ALL SELECT c.group_id, c.title_id, c.pos, spent + c.ordinal <= 70, CASE WHEN spent + c.ordinal <= 70 THEN spent + c.ordinal ELSE spent END FROM run JOIN c ON c.group_id = run.group_id AND c.pos = run.pos + 1),
v AS (SELECT title_id, CASE WHEN NOT paid THEN NULL WHEN title_id % 4 = 0 THEN 'unavailable' WHEN title_id % 3 = 0 THEN 'disagrees' ELSE 'agrees' END AS verdict FROM run)
SELECT title_id AS assertion_id, verdict, CASE WHEN verdict = 'disagrees' THEN 'low' ELSE 'high' END AS confidence FROM v""",
)
def recheck(t: Tables) -> DataFrame:
    rows = ranked(t.titles(), ["group_id"], ["title_id"], "pos")
    said = rows.select("group_id", F.col("title_id").alias("assertion_id"), "pos", F.col("ordinal").alias("cost"), F.col("ordinal").alias("stated"), F.lit("high").alias("confidence"))
    found = t.titles().where("title_id % 4 <> 0").select(F.col("title_id").alias("assertion_id"), (F.col("ordinal") + (F.col("title_id") % 3 == 0).cast("int")).alias("found"))
    return p.rechecked(said, found, 70)


@query(
    "R17_work_metadata",
    "titles",
    """SELECT title_id AS work_id, CASE WHEN title_id % 7 <> 0 THEN title END AS title,
  CASE WHEN title_id % 3 = 0 THEN (CASE WHEN title_id % 5 <> 0 THEN 'tmdb-' || ordinal ELSE '' END) WHEN title_id % 7 <> 0 THEN 'own-' || service ELSE '' END AS genres FROM titles""",
)
def metadata(t: Tables) -> DataFrame:
    kind = case(F.col("title_id"), "anime", "film", "tv").alias("media_kind")
    x = t.titles().withColumnRenamed("title_id", "work_id").withColumn("media_kind", case(F.col("work_id"), "anime", "film", "tv"))
    own = x.where("work_id % 7 <> 0").select("work_id", "media_kind", "title", F.array(F.concat(F.lit("own-"), "service")).alias("genres"))
    tmdb = x.where("work_id % 5 <> 0").select("work_id", F.array(F.concat(F.lit("tmdb-"), F.col("ordinal").cast("string"))).alias("tmdb_genres"))
    return p.work_metadata(t.titles().select(F.col("title_id").alias("work_id"), kind), own, tmdb).withColumn("genres", F.array_join("genres", ","))


@query(
    "R16_opened_hit",
    "titles",
    """+o AS (SELECT title_id AS ref, list_extract(['complete', 'pending', 'retryable', 'conflict', 'unknown'], CAST(title_id % 5 + 1 AS INT)) AS outcome, group_id FROM titles)
SELECT ref, CASE outcome WHEN 'complete' THEN 'ready' WHEN 'retryable' THEN 'pending' ELSE outcome END AS kind, CASE WHEN outcome NOT IN ('conflict', 'unknown') THEN group_id END AS continuity_id,
  CASE WHEN outcome IN ('pending', 'retryable') THEN 5 END AS retry_after, CASE WHEN outcome = 'pending' THEN '/status/' || ref END AS status_url FROM o""",
)
def opened(t: Tables) -> DataFrame:
    outcome = case(F.col("title_id"), "complete", "pending", "retryable", "conflict", "unknown")
    return p.opened(
        t.titles().select(
            F.col("title_id").alias("ref"),
            outcome.alias("outcome"),
            F.col("group_id").alias("continuity_id"),
            F.lit(5).alias("retry_after"),
            F.concat(F.lit("/status/"), F.col("title_id").cast("string")).alias("status_url"),
        )
    )


@query(
    "R2_instalment_answer",
    "titles edges",
    """SELECT a.title_id, a.unit_id, coalesce(string_agg(DISTINCT b.service, ',' ORDER BY b.service), '') AS services, count(b.title_id) AS n_counterparts
FROM edges a LEFT JOIN edges b ON a.unit_id = b.unit_id AND a.service <> b.service GROUP BY 1, 2""",
)
def instalments(t: Tables) -> DataFrame:
    return p.unit_answers(t.edges())
