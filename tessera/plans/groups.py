"""Queries on whole groups: flags, revalidation, continuities, search hits and pages of works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import answers as a
from tessera.operators import groups as g
from tessera.operators.curation import insert_ignore
from tessera.plans.discovery import ASSERT, assertions
from tessera.plans.registry import query
from tessera.sources.bindings import Tables


@query(
    "T19w_low_confidence_flags",
    "titles",
    """+c AS (SELECT title_id AS x, title_id + ordinal % 5 - 2 AS y, CASE WHEN ordinal % 3 = 0 THEN 'high' ELSE 'low' END AS confidence, ordinal FROM titles),
f AS (SELECT 'low-confidence-flag' AS kind, 'title:' || x AS subject_key, 'low-confidence-flag:' || x * 10 || ':' || ordinal AS evidence_hash, confidence FROM c WHERE ordinal % 4 = 0
  UNION ALL SELECT 'low-confidence-flag', 'title-pair:' || least(x, y) || ',' || greatest(x, y), 'low-confidence-flag:title:' || least(x, y) || ':' || greatest(x, y), confidence FROM c WHERE ordinal % 4 IN (1, 2)
  UNION ALL SELECT 'low-confidence-flag', 'title-pair:' || least(x, y) || ',' || greatest(x, y), 'low-confidence-flag:relation:' || x || '->' || y, confidence FROM c WHERE ordinal % 4 = 3),
o AS (SELECT kind, subject_key, evidence_hash, 'open' AS confidence FROM f WHERE subject_key LIKE '%1')
SELECT DISTINCT * FROM o UNION ALL SELECT kind, subject_key, evidence_hash, min(confidence) FROM f WHERE subject_key NOT LIKE '%1' GROUP BY 1, 2, 3""",
)
def flags(t: Tables) -> DataFrame:
    i, o = F.col("title_id"), F.col("ordinal")
    c = t.titles().select(i, (i + o % 5 - 2).alias("other"), F.when(o % 3 == 0, "high").otherwise("low").alias("confidence"), o)
    ends = [i.alias("from_id"), F.col("other").alias("to_id"), "confidence"]
    found = g.low_confidence_flags(c.where("ordinal % 4 = 0").select(i, (i * 10).alias("instalment_id"), o.alias("unit_id"), "confidence"), c.where("ordinal % 4 IN (1, 2)").select(*ends), c.where("ordinal % 4 = 3").select(*ends))
    open_ = found.where("subject_key LIKE '%1'").withColumn("confidence", F.lit("open")).distinct()
    return insert_ignore(open_, found, ["kind", "subject_key", "evidence_hash"])


@query(
    "T21w_group_revalidation",
    "titles",
    ASSERT.replace("CAST(floor(title_id / 3) AS BIGINT) AS pairing_id, title_id + 1 AS instalment_id", "CAST(floor(title_id / 3) AS BIGINT) AS pairing_id, title_id AS instalment_id")
    + """, gr AS (SELECT title_id AS instalment_id, group_id FROM titles), stop AS (SELECT DISTINCT group_id FROM titles WHERE group_id % 5 = 3),
aa AS (SELECT a.*, group_id FROM a JOIN gr USING (instalment_id)), pp AS (SELECT p.*, group_id FROM p JOIN gr USING (instalment_id) WHERE group_id NOT IN (SELECT * FROM stop)),
fr AS (SELECT * FROM aa WHERE group_id NOT IN (SELECT * FROM stop)),
bad AS (SELECT DISTINCT pairing_id FROM pp WHERE instalment_id IN (SELECT instalment_id FROM fr WHERE source IN ('llm-research', 'community', 'manual'))),
k AS (SELECT group_id, instalment_id, unit_id, source FROM fr WHERE source IN ('llm-research', 'community', 'manual') UNION ALL SELECT group_id, instalment_id, unit_id, source FROM pp WHERE pairing_id NOT IN (SELECT * FROM bad)),
v AS (SELECT *, row_number() OVER (PARTITION BY group_id, source ORDER BY instalment_id) * 2 <= 3 AND source = 'llm-research' AS paid FROM k)
SELECT group_id, instalment_id, unit_id, source, CASE WHEN NOT paid THEN NULL WHEN instalment_id % 5 = 0 THEN 'unavailable' WHEN instalment_id % 4 = 1 THEN 'disagrees' ELSE 'agrees' END AS verdict,
  CASE WHEN paid AND instalment_id % 5 <> 0 AND instalment_id % 4 = 1 THEN 'low' ELSE 'high' END AS confidence FROM v
UNION ALL SELECT group_id, instalment_id, unit_id, source, NULL, 'high' FROM aa WHERE group_id IN (SELECT * FROM stop)""",
)
def revalidated(t: Tables) -> DataFrame:
    i, o = F.col("title_id"), F.col("ordinal")
    group = t.titles().select(i.alias("instalment_id"), "group_id")
    pairings = t.titles().where("group_id % 2 = 0").select("group_id", F.floor(i / 3).cast("long").alias("pairing_id"), i.alias("instalment_id"), (o + 100).alias("unit_id"), F.lit("t3-episode").alias("source"))
    records = t.titles().where("title_id % 5 <> 0").select(i.alias("instalment_id"), (o + (i % 4 == 1).cast("int")).alias("found"))
    return g.revalidate(assertions(t).join(group, "instalment_id"), pairings, t.titles().where("group_id % 5 = 3").select("group_id"), records, F.lit(2), 3)


#: Continuities over the titles of two to four groups, some titles in none; a title is in one.
HELD = """seg AS (SELECT CAST(floor(title_id / 12) AS BIGINT) + 7 * (title_id % 2) AS continuity_id, CAST(row_number() OVER (PARTITION BY CAST(floor(title_id / 12) AS BIGINT) + 7 * (title_id % 2) ORDER BY title_id DESC) AS BIGINT) AS pos, title_id FROM titles WHERE group_id % 3 <> 1 AND ordinal % 4 = 0),
placed AS (SELECT seg.*, group_id FROM seg JOIN titles USING (title_id)),"""
JOINED = HELD + """
h AS (SELECT DISTINCT rq.*, continuity_id FROM rq JOIN placed ON group_id IN (fg, tg)),
s AS (SELECT rq.*, min(continuity_id) AS sv FROM rq LEFT JOIN h USING (r) GROUP BY ALL),
m0 AS (SELECT h.r, p.*, p.continuity_id = sv AS own FROM h JOIN s USING (r) JOIN placed p ON p.continuity_id = h.continuity_id),
m AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY r, title_id ORDER BY own DESC, continuity_id, pos) = 1),
st AS (SELECT s.*, coalesce(bool_or(group_id = fg), false) AS f_in, coalesce(bool_or(group_id = tg), false) AS t_in, coalesce(bool_or(group_id = tg AND own), false) AND NOT coalesce(bool_or(group_id = fg AND own), false) AS before FROM s LEFT JOIN m USING (r) GROUP BY ALL),
al AS (SELECT r, sv, title_id, CASE WHEN own THEN 1 WHEN before THEN 0 ELSE 2 END AS part, continuity_id AS c, pos AS o, false AS added FROM m JOIN st USING (r)
  UNION ALL SELECT r, sv, ft, CASE WHEN t_in THEN -1 ELSE 3 END, NULL, NULL, true FROM st WHERE ft IS NOT NULL AND NOT f_in UNION ALL SELECT r, sv, tt, 4, NULL, NULL, true FROM st WHERE tt IS NOT NULL AND NOT t_in),
j AS (SELECT r AS request_id, sv AS continuity_id, title_id, row_number() OVER (PARTITION BY r ORDER BY part, c, o) - 1 AS pos, added FROM al)"""


def held(t: Tables) -> DataFrame:
    i = F.col("title_id")
    rows = t.titles().where("group_id % 3 <> 1 AND ordinal % 4 = 0").select((F.floor(i / 12) + 7 * (i % 2)).cast("long").alias("continuity_id"), i)
    return g.ranked(rows, ["continuity_id"], [F.desc("title_id")], "pos").withColumn("pos", F.col("pos").cast("long"))


@query(
    "D13_relation_continuities",
    "titles",
    "+rq AS (SELECT x.title_id AS r, x.group_id AS fg, y.group_id AS tg, x.title_id AS ft, y.title_id AS tt FROM titles x JOIN titles y ON y.title_id = x.title_id + x.ordinal % 20 - 4 WHERE x.group_id <> y.group_id),\n" + JOINED + " SELECT * FROM j",
)
def related(t: Tables) -> DataFrame:
    i, o = F.col("title_id"), F.col("ordinal")
    to = t.titles().select(i.alias("to_title"), F.col("group_id").alias("to_group"))
    asked = t.titles().select(i.alias("request_id"), F.col("group_id").alias("from_group"), i.alias("from_title"), (i + o % 20 - 4).alias("to_title")).join(to, "to_title")
    return g.join_continuities(asked, t.titles(), held(t))


@query(
    "D13_group_continuities",
    "titles anidb",
    "+rq AS (SELECT DISTINCT group_id AS r, group_id AS fg, group_id AS tg, CAST(NULL AS BIGINT) AS ft, CAST(NULL AS BIGINT) AS tt FROM titles),\n" + JOINED + """,
sp AS (SELECT *, CASE WHEN service = 'anidb' THEN 0 WHEN service IN ('anilist', 'kitsu', 'mal') THEN 1 WHEN service = 'tmdb' THEN 2 END AS k FROM anidb WHERE group_id NOT IN (SELECT request_id FROM j)),
best AS (SELECT * FROM sp WHERE k IS NOT NULL QUALIFY k = min(k) OVER (PARTITION BY group_id))
SELECT * FROM j UNION ALL SELECT group_id, NULL, title_id, row_number() OVER (PARTITION BY group_id ORDER BY ordinal, title_id) - 1, true FROM best""",
)
def ensured(t: Tables) -> DataFrame:
    titles = t.titles_with_anidb()
    return g.ensure_continuities(titles, titles, held(t))


@query(
    "R18_search_hits",
    "titles",
    """+f AS (SELECT *, group_id AS query_id, CASE group_id % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'movie' ELSE 'tv' END AS scope, CASE ordinal % 3 WHEN 0 THEN 'movie' WHEN 1 THEN 'tv' ELSE 'person' END AS media_type FROM titles WHERE title_id % 2 = 0),
k AS (SELECT *, CASE WHEN scope = 'multi' THEN media_type ELSE scope END AS namespace FROM f),
l AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ordinal, CAST(title_id AS VARCHAR)) AS place, 0 AS list, 'tmdb' AS service, namespace, CAST(title_id AS VARCHAR) AS id,
  coalesce(CASE WHEN ordinal % 5 <> 0 THEN title END, '') AS title, CASE WHEN namespace = 'movie' THEN (CASE WHEN ordinal % 7 <> 0 THEN 1960 + ordinal END) END AS year, CASE WHEN namespace = 'movie' THEN 'film' ELSE 'tv' END AS media_kind, '/p' AS cover
  FROM k WHERE namespace IN ('movie', 'tv')
  UNION ALL SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY ordinal, CAST(title_id AS VARCHAR)), 1, 'anilist', NULL, CAST(title_id AS VARCHAR), title, CASE WHEN ordinal % 2 = 0 THEN 1970 + ordinal ELSE 1980 END, 'anime', CASE WHEN ordinal % 3 > 0 THEN 'c' END
  FROM titles WHERE title_id % 2 = 1 AND group_id % 3 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, list) AS INT) AS rank, service, namespace, id, title, CAST(year AS INT) AS year, media_kind, cover FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place, list) <= 6""",
)
def hits(t: Tables) -> DataFrame:
    i, o = F.col("title_id"), F.col("ordinal")
    scope = F.when(F.col("group_id") % 3 == 0, "multi").when(F.col("group_id") % 3 == 1, "movie").otherwise("tv")
    kind = F.when(o % 3 == 0, "movie").when(o % 3 == 1, "tv").otherwise("person")
    item = t.titles().select(F.col("group_id").alias("query_id"), scope.alias("scope"), o.alias("place"), i.alias("id"), kind.alias("media_type"), F.when(o % 5 != 0, F.col("title")).alias("name"), o.alias("ordinal"), "title")
    dated = F.when(o % 7 != 0, F.concat((o + 1960).cast("string"), F.lit("-01-01")))
    first = item.where("id % 2 = 0").withColumn("title", F.lit(None).cast("string")).withColumn("release_date", dated).withColumn("first_air_date", F.lit("soon")).withColumn("poster", F.lit("/p"))
    second = item.where("id % 2 = 1 AND query_id % 3 = 0").select("query_id", "place", "id", F.lit(None).cast("string").alias("english"), F.col("title").alias("romaji"), F.when(o % 2 == 0, o + 1970).alias("season_year"), F.lit(1980).alias("start_year"), F.when(o % 3 > 0, "c").otherwise("").alias("cover"))
    return a.search_hits(first, second, 6)


ASKED = """rq AS (SELECT DISTINCT user_id, 'continuity:' || work_id AS work_key, 'continuity:' || (work_id + 20) AS asked_key FROM statuses WHERE work_id % 3 = 0),
al AS (SELECT DISTINCT 'continuity:' || (work_id + d) AS retired, 'continuity:' || work_id AS work_key FROM works, (SELECT unnest([1, 2]) AS d) WHERE work_id % 3 = 0),
ky AS (SELECT user_id, work_key, key, min(rank) AS rank FROM (SELECT user_id, work_key, work_key AS key, 0 AS rank FROM rq UNION ALL SELECT user_id, work_key, asked_key, 1 FROM rq
  UNION ALL SELECT rq.user_id, rq.work_key, retired, 2 FROM rq JOIN al USING (work_key)) GROUP BY 1, 2, 3)"""


def asked(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = lambda n: F.concat(F.lit("continuity:"), n.cast("string"))
    w = F.col("work_id")
    requests = t.statuses().where("work_id % 3 = 0").select("user_id", key(w).alias("work_key"), key(w + 20).alias("asked_key")).distinct()
    aliases = t.works().where("work_id % 3 = 0").select(key(w).alias("work_key"), F.explode(F.array(key(w + 1), key(w + 2))).alias("retired")).distinct()
    return requests, aliases


@query(
    "R10_viewer_state",
    "statuses works",
    f"+{ASKED}, " + """ss AS (SELECT user_id, 'continuity:' || (CASE WHEN work_id % 4 = 0 THEN work_id + 20 ELSE work_id END) AS key, status FROM statuses), nn AS (SELECT user_id, 'continuity:' || work_id AS key, 'n' || work_id AS body FROM statuses WHERE work_id % 5 > 1),
b AS (SELECT user_id, work_key, arg_min(status, (rank, key)) AS status FROM ky JOIN ss USING (user_id, key) GROUP BY 1, 2), n AS (SELECT user_id, work_key, arg_min(body, (rank, key)) AS note FROM ky JOIN nn USING (user_id, key) GROUP BY 1, 2)
SELECT DISTINCT rq.user_id, rq.work_key, status, note FROM rq LEFT JOIN b USING (user_id, work_key) LEFT JOIN n USING (user_id, work_key)""",
)
def viewed(t: Tables) -> DataFrame:
    w = F.col("work_id")
    key = lambda n: F.concat(F.lit("continuity:"), n.cast("string")).alias("key")
    statuses = t.statuses().select("user_id", key(F.when(w % 4 == 0, w + 20).otherwise(w)), "status")
    notes = t.statuses().where("work_id % 5 > 1").select("user_id", key(w), F.concat(F.lit("n"), w.cast("string")).alias("body"))
    return a.viewer(*asked(t), statuses, notes)


@query(
    "R10_work_blocks",
    "progress statuses works",
    f"+{ASKED}, " + """ins AS (SELECT 'continuity:' || work_id AS work_key, CAST(CASE WHEN pos = 0 THEN 0 ELSE 1 END AS INT) AS place, pos = 0 AS film, pos, locator, CASE WHEN pos <> 2 THEN 'T' || pos END AS title FROM works),
rt AS (SELECT event_id AS rating_id, user_id, k, k % 10 + 1 AS score FROM ev WHERE event_type = 'purchase'),
pt AS (SELECT user_id, work_key, arg_max(score, (rank = 0, rating_id)) AS part_score FROM (SELECT *, 'continuity:' || (k % 20) AS key FROM rt) JOIN ky USING (user_id, key) GROUP BY 1, 2),
ow AS (SELECT user_id, 'w#' || k AS locator, k % 5 = 0 AS film, arg_max(score, rating_id) AS own FROM rt GROUP BY 1, 2, 3),
pg AS (SELECT DISTINCT user_id, work_key, place, film, pos, locator, title FROM rq JOIN ins USING (work_key)),
ep AS (SELECT pg.*, row_number() OVER (PARTITION BY pg.user_id, work_key, place ORDER BY pos) AS number, own, EXISTS (SELECT 1 FROM progress p WHERE p.user_id = pg.user_id AND p.locator = pg.locator) AS seen
  FROM pg LEFT JOIN ow ON ow.user_id = pg.user_id AND ow.locator = pg.locator AND ow.film = pg.film)
SELECT ep.user_id, ep.work_key, place, CASE WHEN film THEN 'film' ELSE 'part' END AS block, CAST(CASE WHEN film THEN max(own) ELSE max(part_score) END AS INT) AS score,
  string_agg(number || '/' || locator || '/' || coalesce(title, 'Episode ' || number) || '/' || seen || '/' || coalesce(CAST(own AS VARCHAR), '-'), ' ' ORDER BY number) AS episodes
FROM ep LEFT JOIN pt ON pt.user_id = ep.user_id AND pt.work_key = ep.work_key GROUP BY ep.user_id, ep.work_key, place, film""",
)
def blocks(t: Tables) -> DataFrame:
    p, k = F.col("pos"), F.col("k")
    ins = t.works().select(F.concat(F.lit("continuity:"), F.col("work_id").cast("string")).alias("work_key"), (p > 0).cast("int").alias("place"), F.when(p == 0, "atomic").otherwise("episodic").alias("kind"), "pos", "locator", F.when(p != 2, F.concat(F.lit("T"), p.cast("string"))).alias("title"))
    bought = t.events().where("event_type = 'purchase'").select(F.col("event_id").alias("rating_id"), "user_id", k, (k % 10 + 1).alias("score"))
    rated = lambda kind, key: bought.select("rating_id", "user_id", kind.alias("unit_kind"), key.alias("unit_key"), "score")
    ratings = rated(F.lit("part"), F.concat(F.lit("part:continuity:"), (k % 20).cast("string"), F.lit(":1"))).unionByName(rated(F.when(k % 5 == 0, "movie").otherwise("episode"), F.concat(F.lit("w#"), k.cast("string"))))
    found = a.work_blocks(*asked(t), ins, t.progress(), ratings)
    shown = F.transform("episodes", lambda e: F.concat_ws("/", e["number"].cast("string"), e["locator"], e["title"], e["watched"].cast("string"), F.coalesce(e["score"].cast("string"), F.lit("-"))))
    return found.withColumn("episodes", F.concat_ws(" ", shown))
