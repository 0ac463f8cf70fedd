"""Queries on discovery, verification and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import curation as c
from tessera.operators import discovery as d
from tessera.operators import matcher, moderation
from tessera.plans.registry import query
from tessera.plans.scalars import NORM, SIMILAR, TOKENS
from tessera.sources.bindings import Tables

REL = """+rel AS (SELECT title_id AS from_id, title_id + 1 AS to_id, 'sequel' AS kind FROM titles WHERE group_id % 5 <> 4 AND title_id % 8 <> 7
  UNION ALL SELECT title_id + 1, title_id, 'prequel' FROM titles WHERE ordinal % 3 > 0 AND title_id % 8 <> 7 UNION ALL SELECT title_id, title_id + 2, 'sequel' FROM titles WHERE title_id % 40 = 1)"""


def relations(t: Tables) -> DataFrame:
    x, i = t.titles(), F.col("title_id")
    make = lambda df, a, b, kind: df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("kind"))
    return (
        make(x.where("group_id % 5 <> 4 AND title_id % 8 <> 7"), i, i + 1, "sequel")
        .unionByName(make(x.where("ordinal % 3 > 0 AND title_id % 8 <> 7"), i + 1, i, "prequel"))
        .unionByName(make(x.where("title_id % 40 = 1"), i, i + 2, "sequel"))
    )


@query("J14_mutual_evidence", "titles", REL + " SELECT from_id, to_id, kind FROM rel a WHERE EXISTS (SELECT 1 FROM rel b WHERE b.from_id = a.to_id AND b.to_id = a.from_id)")
def mutual(t: Tables) -> DataFrame:
    return d.mutual(relations(t)).select("from_id", "to_id", "kind")


@query("J15_two_sided_edge_D5", "titles", REL + " SELECT from_id, to_id, CASE WHEN EXISTS (SELECT 1 FROM rel b WHERE b.kind = 'prequel' AND b.from_id = a.to_id AND b.to_id = a.from_id) THEN 'high' ELSE 'low' END AS confidence FROM rel a WHERE kind = 'sequel'")
def two_sided(t: Tables) -> DataFrame:
    return d.two_sided_chain(relations(t))


#: Blocks of 61 titles are chains; every second block has shows, missing entries and branches, every third is closed to a cycle.
WALK = """+b AS (SELECT title_id AS i, title_id // 61 AS blk, title_id % 61 AS spot FROM titles),
ent AS (SELECT i AS id, CASE WHEN blk % 2 = 1 AND i % 29 = 11 THEN 'show' WHEN i % 7 = 3 THEN 'movie' ELSE 'anime' END AS type FROM b WHERE NOT (blk % 2 = 1 AND i % 41 = 20)),
mrel AS (SELECT i AS from_id, 'sequel' AS kind, i + 1 AS to_id FROM b WHERE spot < 60 UNION ALL SELECT i + 1, 'prequel', i FROM b WHERE spot < 60 AND i % 17 <> 5
  UNION ALL SELECT i, 'sequel', i + 2 FROM b WHERE blk % 2 = 1 AND i % 53 = 9 UNION ALL SELECT i, 'sequel', i - 60 FROM b WHERE spot = 60 AND blk % 3 = 2 UNION ALL SELECT i, 'side_story', i + 3 FROM b WHERE i % 4 = 0),
per AS (SELECT from_id, kind, count(*) AS n, string_agg(from_id || '>' || to_id, ',' ORDER BY to_id) AS said, min(to_id) AS to_id FROM mrel WHERE kind <> 'side_story' GROUP BY 1, 2),
branch AS (SELECT from_id AS id, arg_min(kind || ':' || said, kind) AS said FROM per WHERE n > 1 GROUP BY 1),
walk(start, phase, node, seen, back, ahead, reason, entry, said) AS (
  SELECT e.id, CASE WHEN e.type <> 'anime' OR h.id IS NOT NULL THEN 2 ELSE 0 END, e.id, [e.id], CAST([] AS BIGINT[]), CAST([] AS BIGINT[]),
    CASE WHEN e.type <> 'anime' THEN 'non-anime-candidate' WHEN h.id IS NOT NULL THEN 'ambiguous-branch' END, CASE WHEN e.type <> 'anime' OR h.id IS NOT NULL THEN e.id END,
    CASE WHEN e.type <> 'anime' THEN '' ELSE h.said END
  FROM ent e LEFT JOIN branch h ON h.id = e.id
  UNION ALL
  SELECT start, CASE WHEN step = 'go' THEN phase WHEN step = 'end' THEN phase + 1 ELSE 2 END, CASE WHEN step = 'go' THEN to_id ELSE start END,
    CASE WHEN step = 'go' THEN list_append(seen, to_id) ELSE seen END, CASE WHEN step = 'go' AND phase = 0 THEN list_append(back, to_id) ELSE back END,
    CASE WHEN step = 'go' AND phase = 1 THEN list_append(ahead, to_id) ELSE ahead END, CASE WHEN step NOT IN ('go', 'end') THEN step END,
    CASE step WHEN 'cycle-closing-link' THEN node WHEN 'non-anime-candidate' THEN to_id WHEN 'ambiguous-branch' THEN to_id END,
    CASE WHEN step = 'ambiguous-branch' THEN bsaid WHEN step NOT IN ('go', 'end') THEN kind || ':' || node || '>' || to_id END
  FROM (SELECT w.*, p.to_id, p.kind, h.said AS bsaid,
      CASE WHEN p.to_id IS NULL THEN 'end' WHEN list_contains(seen, p.to_id) THEN 'cycle-closing-link' WHEN e.id IS NULL THEN 'end' WHEN e.type = 'show' THEN 'non-anime-candidate'
        WHEN h.id IS NOT NULL THEN 'ambiguous-branch' ELSE 'go' END AS step
    FROM walk w LEFT JOIN per p ON p.from_id = w.node AND p.kind = CASE w.phase WHEN 0 THEN 'prequel' ELSE 'sequel' END
    LEFT JOIN ent e ON e.id = p.to_id LEFT JOIN branch h ON h.id = p.to_id WHERE w.phase < 2)) /*recursive*/"""


def walked(t: Tables) -> d.Continuity:
    i = F.col("title_id")
    rows = t.titles().select(i, F.floor(i / 61).alias("blk"), (i % 61).alias("at"))
    odd = F.col("blk") % 2 == 1
    kind = F.when(odd & (i % 29 == 11), "show").when(i % 7 == 3, "movie").otherwise("anime")
    entries = rows.where(~(odd & (i % 41 == 20))).select(i.alias("entry_id"), kind.alias("type"))
    edge = lambda where, a, name, b: rows.where(where).select(a.alias("from_id"), F.lit(name).alias("kind"), b.alias("to_id"))
    edges = edge("at < 60", i, "sequel", i + 1).unionByName(edge("at < 60 AND title_id % 17 <> 5", i + 1, "prequel", i)).unionByName(edge("blk % 2 = 1 AND title_id % 53 = 9", i, "sequel", i + 2))
    edges = edges.unionByName(edge("at = 60 AND blk % 3 = 2", i, "sequel", i - 60)).unionByName(edge("title_id % 4 = 0", i, "side_story", i + 3))
    return d.continuity(entries, edges, entries.select("entry_id"))


@query(
    "D1_continuity_walk",
    "titles",
    WALK + """ SELECT start AS chain_id, node, CAST(pos - 1 AS INT) AS pos FROM (
  SELECT start, unnest(path) AS node, generate_subscripts(path, 1) AS pos FROM (SELECT start, list_concat(list_reverse(back), [start], ahead) AS path FROM walk WHERE phase = 2 AND reason IS NULL))""",
)
def walks(t: Tables) -> DataFrame:
    return walked(t).chains.select("chain_id", "node", F.col("pos").cast("int").alias("pos"))


@query("D1_walk_refusals", "titles", WALK + " SELECT start AS chain_id, reason, entry AS entry_id, said AS competing FROM walk WHERE phase = 2 AND reason IS NOT NULL")
def refusals(t: Tables) -> DataFrame:
    said = F.array_join(F.transform("competing", lambda c: F.concat(c["from_id"].cast("string"), F.lit(">"), c["to_id"].cast("string"))), ",")
    competing = F.when(F.size("competing") == 0, "").otherwise(F.concat(F.col("competing")[0]["kind"], F.lit(":"), said))
    return walked(t).refusals.select("chain_id", "reason", "entry_id", competing.alias("competing"))


@query("D1_ambiguous_branch", "titles", REL + " SELECT from_id AS node, kind, count(DISTINCT to_id) AS n FROM rel GROUP BY 1, 2 HAVING count(DISTINCT to_id) > 1")
def branches(t: Tables) -> DataFrame:
    return d.branches(relations(t))


RUNS = """+runs AS (SELECT title_id AS run_id, CASE WHEN ordinal % 7 > 0 THEN ordinal END AS size, CASE WHEN ordinal % 5 > 0 THEN ordinal + (CASE WHEN title_id % 6 = 0 THEN 1 ELSE 0 END) END AS target_count,
  CASE WHEN title_id % 4 > 0 THEN CAST(DATE '2000-01-01' + CAST(title_id % 900 AS INT) AS VARCHAR) END AS a, CAST(DATE '2000-06-01' + CAST(title_id % 300 AS INT) AS VARCHAR) AS b, title_id % 3 = 0 AS fmt, title_id % 5 = 0 AS rel FROM titles),
g AS (SELECT *, abs(date_diff('day', CAST(a AS DATE), CAST(b AS DATE))) AS gap, size IS NOT NULL AND target_count IS NOT NULL AS counted FROM runs)
SELECT run_id, CASE WHEN counted AND size <> target_count THEN 'count-mismatch' WHEN gap > 366 THEN 'date-mismatch' WHEN NOT counted THEN 'candidate' WHEN coalesce(gap <= 366, false) OR fmt OR rel THEN 'assert-high' ELSE 'assert-low' END AS verdict FROM g"""


@query("D4_verify_run_D3", "titles", RUNS)
def verdicts(t: Tables) -> DataFrame:
    i, o = F.col("title_id"), F.col("ordinal")
    day = lambda s, m: F.date_add(F.lit(s).cast("date"), (i % m).cast("int")).cast("string")
    runs = t.titles().select(
        i.alias("run_id"), F.when(o % 7 > 0, o).alias("size"), F.when(o % 5 > 0, o + F.when(i % 6 == 0, 1).otherwise(0)).alias("target_count"), F.when(i % 4 > 0, day("2000-01-01", 900)).alias("date"),
        day("2000-06-01", 300).alias("target_date"), F.lit("").alias("title"), F.lit("").alias("target_title"), (i % 3 == 0).alias("format_agrees"), (i % 5 == 0).alias("related"),
    )
    return d.verify_runs(runs)


@query("W12_member_order_D7", "titles", "SELECT group_id, title_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN ordinal % 3 > 0 THEN 2000 + ordinal END NULLS LAST, native, service) AS INT) AS place FROM titles")
def order(t: Tables) -> DataFrame:
    return d.member_order(t.titles().withColumn("date", F.when(F.col("ordinal") % 3 > 0, F.col("ordinal") + 2000))).select("group_id", "title_id", "place")


@query(
    "W13_bucket_hits_W14_best_D8_O11",
    "",
    """WITH h AS (SELECT l_orderkey AS query_id, l_suppkey AS ref, max(l_discount * 10) AS score FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref) AS INT) AS place FROM h)
SELECT query_id, ref, score, place, CASE WHEN score < 0.7 THEN 'also-considered' WHEN place <= 2 THEN 'member' ELSE 'over-cap' END AS bucket FROM p""",
)
def buckets(t: Tables) -> DataFrame:
    return d.bucket_hits(t.table("lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("ref"), (F.col("l_discount") * 10).alias("score")))


FUZZY = f"""+t AS (SELECT *, {NORM.format("title || CASE WHEN title_id % 3 = 0 THEN ' ii' ELSE '' END")} AS b, CASE WHEN ordinal % 6 > 0 THEN 1990 + ordinal END AS yb FROM titles),
asked AS (SELECT group_id AS query_id, group_id, s.x AS service, {NORM.format("title || ' the'")} AS a, CASE WHEN ordinal % 5 > 0 THEN 1990 + ordinal END AS ya FROM titles, (SELECT unnest(['mal', 'imdb']) AS x) s WHERE title_id % 8 = 0),
p AS (SELECT query_id, title_id AS ref, asked.service, a, b, ya, yb, {TOKENS.format("a")} AS ta, {TOKENS.format("b")} AS tb FROM asked JOIN t ON t.service = asked.service AND t.group_id <> asked.group_id),
s AS (SELECT *, {SIMILAR} AS s FROM p WHERE list_has_any(ta, tb)),
h AS (SELECT query_id, ref, round(CASE WHEN ya IS NULL OR yb IS NULL THEN s ELSE s * 0.6 + (CASE WHEN abs(ya - yb) <= 1 THEN 1 ELSE 0 END) * 0.4 END, 9) AS score, service FROM s),
best AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, service ORDER BY score DESC, ref) <= 8),
placed AS (SELECT query_id, ref, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref) AS INT) AS place FROM best),
bucketed AS (SELECT *, CASE WHEN score < 0.7 THEN 'also-considered' WHEN place <= 2 THEN 'member' ELSE 'over-cap' END AS bucket FROM placed)"""


def proposed(t: Tables) -> d.Fuzzy:
    """Each group's first title asks two catalogues; what a third of the groups would propose first was rejected before."""
    i, o = F.col("title_id"), F.col("ordinal")
    year = lambda n: F.when(o % n > 0, o + 1990)
    titles = t.titles().select(i.alias("ref"), "service", F.concat("title", F.when(i % 3 == 0, " ii").otherwise("")).alias("title"), year(6).alias("year"), "group_id")
    heads = t.titles().where("title_id % 8 = 0").select(F.col("group_id").alias("query_id"), "group_id", F.concat("title", F.lit(" the")).alias("title"), year(5).alias("year"))
    queries = heads.withColumn("service", F.explode(F.array(F.lit("mal"), F.lit("imdb"))))
    rejected = titles.where("ref % 24 < 3").select(F.floor(F.col("ref") / 24).cast("long").alias("query_id"), F.col("ref").cast("string").alias("evidence"))
    return d.fuzzy(queries, titles, rejected)


@query("D8_fuzzy_discovery", "titles", FUZZY + " SELECT query_id, ref, round(score, 6) AS score, place, bucket FROM bucketed")
def fuzzy_hits(t: Tables) -> DataFrame:
    return proposed(t).hits.withColumn("score", F.round("score", 6))


@query(
    "D8_fuzzy_proposals",
    "titles",
    FUZZY + """, m AS (SELECT query_id, string_agg(ref, ',' ORDER BY ref) AS evidence FROM bucketed WHERE bucket = 'member' GROUP BY 1)
SELECT q.query_id, CASE WHEN evidence IS NULL THEN 'no-proposal' WHEN EXISTS (SELECT 1 FROM titles r WHERE title_id % 24 < 3 AND title_id // 24 = q.query_id AND CAST(title_id AS VARCHAR) = evidence) THEN 'suppressed' ELSE 'queued' END AS outcome, evidence
FROM (SELECT DISTINCT query_id FROM asked) q LEFT JOIN m USING (query_id)""",
)
def fuzzy_proposals(t: Tables) -> DataFrame:
    return proposed(t).proposals


CONVERGE = """+disc AS (SELECT CAST(floor(title_id / 12) AS BIGINT) AS discovery_id, title_id FROM titles WHERE ordinal % 13 > 0), st AS (SELECT title_id, CAST(floor(title_id / 4) AS BIGINT) AS group_id, ordinal % 17 = 0 AS curated FROM titles),
touched AS (SELECT DISTINCT discovery_id, group_id FROM disc JOIN st USING (title_id)),
m AS (SELECT t.discovery_id, t.group_id, curated, x.title_id IS NULL AS unnamed FROM touched t JOIN st s USING (group_id) LEFT JOIN disc x ON x.discovery_id = t.discovery_id AND x.title_id = s.title_id),
o AS (SELECT discovery_id, count(DISTINCT group_id) AS n_groups, min(group_id) AS s, CASE WHEN count(DISTINCT group_id) < 2 THEN 'none' WHEN bool_or(curated) THEN 'candidate-curated' WHEN bool_or(unnamed) THEN 'candidate-unnamed' ELSE 'merge' END AS plan FROM m GROUP BY 1)
SELECT discovery_id, n_groups, plan, CASE WHEN plan = 'merge' THEN s END AS survivor FROM o"""


@query("D9_converge_D10_U7", "titles", CONVERGE)
def converge(t: Tables) -> DataFrame:
    x = t.titles()
    disc = x.where("ordinal % 13 > 0").select(F.floor(F.col("title_id") / 12).cast("long").alias("discovery_id"), "title_id")
    return d.converge(disc, x.select("title_id", F.floor(F.col("title_id") / 4).cast("long").alias("group_id"), (F.col("ordinal") % 17 == 0).alias("curated")))


@query("W11_dense_rerank", "titles", """SELECT group_id, title_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN ordinal % 2 = 0 THEN ordinal END NULLS LAST, service, title_id) - 1 AS INT) AS ordinal FROM titles""")
def rerank(t: Tables) -> DataFrame:
    x = t.titles()
    return d.merge_members(x.select("group_id", "title_id", "service"), x.where("ordinal % 2 = 0").select("title_id", "ordinal"))


@query(
    "W4_target_runs_S10_W5_ranges",
    "titles",
    """+s AS (SELECT group_id, title_id, ordinal, CASE WHEN ordinal % 6 > 0 THEN 'tv:' || (ordinal // 10) END AS target FROM titles),
f AS (SELECT *, CASE WHEN target IS NOT NULL AND lag(target) OVER w = target THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY group_id ORDER BY title_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY group_id ORDER BY title_id) AS run, sum(ordinal) OVER (PARTITION BY group_id ORDER BY title_id) AS last FROM f)
SELECT group_id, title_id, CASE WHEN target IS NOT NULL THEN CAST(run AS BIGINT) END AS run, CAST(last - ordinal + 1 AS BIGINT) AS first, CAST(last AS BIGINT) AS last FROM r""",
)
def runs(t: Tables) -> DataFrame:
    s = t.titles().select("group_id", "title_id", "ordinal", F.when(F.col("ordinal") % 6 > 0, F.concat(F.lit("tv:"), F.floor(F.col("ordinal") / 10).cast("string"))).alias("target"))
    marked = matcher.runs(s, ["group_id"], "title_id", ["target"], F.col("target").isNull())
    return matcher.ranges(marked, ["group_id"], "title_id", "ordinal").select("group_id", "title_id", "run", "first", "last")


ASSERT = """+a AS (SELECT title_id AS instalment_id, ordinal AS unit_id, list_extract(['bootstrap', 't1-structure', 't3-episode', 'llm-research', 'community', 'manual'], CAST(title_id % 6 + 1 AS INT)) AS source FROM titles),
p AS (SELECT CAST(floor(title_id / 3) AS BIGINT) AS pairing_id, title_id + 1 AS instalment_id, ordinal + 100 AS unit_id, 't3-episode' AS source FROM titles WHERE group_id % 2 = 0)"""


def assertions(t: Tables) -> DataFrame:
    source = F.element_at(F.array(*map(F.lit, ["bootstrap", "t1-structure", "t3-episode", "llm-research", "community", "manual"])), (F.col("title_id") % 6 + 1).cast("int"))
    return t.titles().select(F.col("title_id").alias("instalment_id"), F.col("ordinal").alias("unit_id"), source.alias("source"))


@query(
    "T4w_recompute_J17_F6",
    "titles",
    ASSERT + """, cur AS (SELECT * FROM a WHERE source IN ('llm-research', 'llm-verified', 'community', 'manual')),
bad AS (SELECT DISTINCT pairing_id FROM p WHERE instalment_id IN (SELECT instalment_id FROM cur))
SELECT * FROM a WHERE source IN ('llm-research', 'llm-verified', 'community', 'manual', 'bootstrap') UNION ALL SELECT instalment_id, unit_id, source FROM p WHERE pairing_id NOT IN (SELECT pairing_id FROM bad)""",
)
def recompute(t: Tables) -> DataFrame:
    pairings = t.titles().where("group_id % 2 = 0").select(
        F.floor(F.col("title_id") / 3).cast("long").alias("pairing_id"), (F.col("title_id") + 1).alias("instalment_id"), (F.col("ordinal") + 100).alias("unit_id"), F.lit("t3-episode").alias("source")
    )
    return c.recompute(assertions(t), pairings)


@query("T11w_promote", "titles", ASSERT + " SELECT instalment_id AS assertion_id, CASE WHEN source = 'llm-research' AND unit_id % 2 = 0 THEN 'llm-verified' ELSE source END AS source FROM a")
def promote(t: Tables) -> DataFrame:
    a = assertions(t).withColumnRenamed("instalment_id", "assertion_id")
    return c.promote(a, a.where("unit_id % 2 = 0").select("assertion_id")).select("assertion_id", "source")


EVIDENCE = """WITH e AS (SELECT o_custkey AS proposal_id, list_extract(['api', 'site', 'scrape', 'wiki', 'api'], CAST(o_orderkey % 5 + 1 AS INT)) AS kind, ' Op' || (o_orderkey % 3) || ' ' AS operator,
  CASE WHEN o_orderkey % 29 = 0 THEN 'contradicts' ELSE 'supports' END AS stance, o_orderkey % 2 = 0 AS validated FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 5 <> 2)"""


@query(
    "F14_corroborate",
    "",
    EVIDENCE + """, o AS (SELECT proposal_id, bool_or(kind = 'scrape' OR stance = 'contradicts') AS bad, count(DISTINCT lower(trim(operator))) AS n, bool_or(kind = 'api' AND validated) AS api FROM e WHERE kind <> 'wiki' GROUP BY 1)
SELECT DISTINCT e.proposal_id, CASE WHEN NOT bad AND n >= 2 AND api THEN 'high' ELSE 'low' END AS confidence FROM e LEFT JOIN o USING (proposal_id)""",
)
def corroborate(t: Tables) -> DataFrame:
    i = F.col("o_orderkey")
    e = t.table("orders").where("o_orderstatus <> 'P' OR o_orderkey % 5 <> 2").select(
        F.col("o_custkey").alias("proposal_id"), F.element_at(F.array(*map(F.lit, ["api", "site", "scrape", "wiki", "api"])), (i % 5 + 1).cast("int")).alias("kind"), F.concat(F.lit(" Op"), (i % 3).cast("string"), F.lit(" ")).alias("operator"),
        F.when(i % 29 == 0, "contradicts").otherwise("supports").alias("stance"), (i % 2 == 0).alias("validated"),
    )
    return c.corroborate(e)


@query(
    "J19_rejected_suppress_T7w_queue",
    "titles",
    """+p AS (SELECT 'title' AS kind, 'k' || (title_id % 300) AS subject_key, 'h' || (ordinal % 5) AS evidence_hash FROM titles), r AS (SELECT DISTINCT * FROM p WHERE subject_key LIKE 'k1%'), o AS (SELECT DISTINCT * FROM p WHERE evidence_hash = 'h2')
SELECT DISTINCT * FROM p EXCEPT SELECT * FROM r EXCEPT SELECT * FROM o""",
)
def queued(t: Tables) -> DataFrame:
    p = t.titles().select(F.lit("title").alias("kind"), F.concat(F.lit("k"), (F.col("title_id") % 300).cast("string")).alias("subject_key"), F.concat(F.lit("h"), (F.col("ordinal") % 5).cast("string")).alias("evidence_hash"))
    return c.queue(p.where("evidence_hash = 'h2'"), p, p.where("subject_key LIKE 'k1%'"))


@query("T1w_insert_ignore", "titles", """+cur AS (SELECT title_id, ordinal FROM titles WHERE title_id % 2 = 0), n AS (SELECT title_id - title_id % 3 AS title_id, ordinal + 1000 AS ordinal FROM titles)
SELECT * FROM cur UNION ALL SELECT title_id, min(ordinal) FROM n WHERE title_id NOT IN (SELECT title_id FROM cur) GROUP BY 1""")
def insert_ignore(t: Tables) -> DataFrame:
    x = t.titles().select("title_id", "ordinal")
    return c.insert_ignore(x.where("title_id % 2 = 0"), x.select((F.col("title_id") - F.col("title_id") % 3).alias("title_id"), (F.col("ordinal") + 1000).alias("ordinal")), ["title_id"])


@query("T2w_upsert_T12w", "ev", """+cur AS (SELECT user_id, k % 20 AS key, event_id, value FROM ev WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, k % 20 ORDER BY event_id DESC) = 1),
n AS (SELECT user_id, k % 20 AS key, event_id, -value AS value FROM ev WHERE event_type = 'click'),
u AS (SELECT *, 0 AS new FROM cur UNION ALL SELECT *, 1 FROM n)
SELECT user_id, key, event_id, value FROM u QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY new DESC, event_id DESC) = 1""")
def upsert(t: Tables) -> DataFrame:
    e = t.events().select("user_id", (F.col("k") % 20).alias("key"), "event_id", "value", "event_type")
    current = c.upsert(e.where("false").drop("event_type"), e.where("event_type = 'view'").drop("event_type"), ["user_id", "key"], "event_id")
    return c.upsert(current, e.where("event_type = 'click'").withColumn("value", -F.col("value")).drop("event_type"), ["user_id", "key"], "event_id")


@query("T6w_settle_T15w_log_fold", "ev", "SELECT k AS candidate_id, event_type AS status FROM ev QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, event_id) = 1")
def settle(t: Tables) -> DataFrame:
    return c.settle(t.events().select(F.col("k").alias("candidate_id"), F.col("ts").alias("at"), F.col("event_id").alias("decision_id"), F.col("event_type").alias("verdict")))


#: Each decision depends on earlier ones, which SQL can't express in reasonable time; ``tests/test_moderation.py`` takes them one after another.
@query("T6w_settle_writes")
def settled(t: Tables) -> DataFrame:
    """Events decide on conflicts of titles; conflicts of neighbours propose the same places."""
    i, e = F.col("title_id"), t.events()
    kinds = [*moderation.RELATIONS, "fuzzy-group"]
    candidates = t.titles().select(i.alias("candidate_id"), F.when(i % 11 == 3, "rejected").otherwise("open").alias("status"), F.element_at(F.array(*map(F.lit, kinds)), (i % 5 + 1).cast("int")).alias("kind"))
    proposals = t.titles().select(i.alias("candidate_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("number"), (i % 17).alias("left_id"), F.floor(i / 9).alias("right_id"), F.when(i % 2 == 0, "high").otherwise("low").alias("confidence"), (i % 13).alias("counterpart_id"))
    proposals = proposals.withColumn("left_id", F.col("left_id") + F.col("number")).where("number = 0 OR candidate_id % 5 = 1")
    decisions = e.select(F.col("event_id").alias("decision_id"), (F.col("event_id") * 7 % 311).alias("candidate_id"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("accept"), (F.col("k") % 3).alias("number"))
    held = t.titles().where("title_id % 19 = 0").select(F.lit("title").alias("relation"), (i % 17).alias("left_id"), F.floor(i / 9).alias("right_id"))
    return moderation.settle_conflicts(candidates, proposals, decisions, held).outcomes


@query("T16w_cascade", "titles edges", "SELECT title_id, unit_id FROM edges WHERE title_id IN (SELECT title_id FROM titles WHERE group_id % 4 <> 0)")
def cascade(t: Tables) -> DataFrame:
    return c.cascade(t.edges().select("title_id", "unit_id"), t.titles().where("group_id % 4 <> 0"), "title_id")


@query("T9w_outranking_F15", "titles", ASSERT + """, r AS (SELECT instalment_id, source, list_position(['bootstrap', 't1-structure', 't2-pattern', 't3-episode', 'llm-research', 'llm-verified', 'community', 'manual'], source) AS k FROM a),
q AS (SELECT instalment_id + 6 AS instalment_id, 'llm-research' AS source FROM a) SELECT q.* FROM q LEFT JOIN r USING (instalment_id) WHERE k IS NULL OR k <= 5""")
def outranking(t: Tables) -> DataFrame:
    a = assertions(t).select("instalment_id", "source")
    return c.outranking(a, a.select((F.col("instalment_id") + 6).alias("instalment_id"), F.lit("llm-research").alias("source")), ["instalment_id"])
