"""Queries on readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.registry import query
from tessera.plans.tracker import ENTRIES, entries
from tessera.sources import readers
from tessera.sources.bindings import Tables


@query("S1_scan_with_predicate", "", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey = 7")
def scan(t: Tables) -> DataFrame:
    return t.table("lineitem").where("l_suppkey = 7").select("l_orderkey", "l_partkey")


@query("S2_external_id_find_S6", "titles", "+f AS (SELECT title_id, CAST(title_id * 3 AS VARCHAR) AS native FROM titles) SELECT f.title_id, t.title_id AS ref FROM f JOIN titles t ON t.native = f.native AND t.service = 'anilist'")
def find(t: Tables) -> DataFrame:
    x = t.titles()
    wanted = x.select("title_id", (F.col("title_id") * 3).cast("string").alias("native"))
    return wanted.join(x.where("service = 'anilist'").select(F.col("title_id").alias("ref"), "native"), "native").select("title_id", "ref")


@query(
    "S3_paged_enumeration_S12",
    "",
    """WITH r AS (SELECT o_custkey AS id, CAST(o_orderkey % 4 + 1 AS INT) AS page, o_orderkey AS row FROM orders), p AS (SELECT id, page, row_number() OVER (PARTITION BY id ORDER BY page) AS n FROM (SELECT DISTINCT id, page FROM r))
SELECT r.id, r.page, r.row, CAST(row_number() OVER (PARTITION BY r.id ORDER BY r.page, r.row) - 1 AS INT) AS pos FROM r JOIN p ON p.id = r.id AND p.page = r.page WHERE n = r.page""",
)
def pages(t: Tables) -> DataFrame:
    r = t.table("orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("page"), F.col("o_orderkey").alias("row"))
    return readers.paged(r, ["id"]).select("id", "page", "row", "pos")


@query(
    "S12_list_walk",
    "",
    """WITH RECURSIVE r AS (SELECT o_custkey % 40 AS list_id, o_orderkey // 50 AS n, o_orderkey AS row, o_orderkey % 97 AS title_id FROM orders),
pg AS (SELECT list_id, n, lead(n) OVER (PARTITION BY list_id ORDER BY n) AS nxt, row_number() OVER (PARTITION BY list_id ORDER BY n) AS i FROM (SELECT DISTINCT list_id, n FROM r)),
led AS (SELECT list_id, n, CASE WHEN list_id % 5 = 1 AND i = 9 THEN (SELECT min(n) FROM pg q WHERE q.list_id = pg.list_id) WHEN list_id % 5 = 2 AND i = 7 THEN NULL ELSE nxt END AS nxt FROM pg),
walk(list_id, n, place, seen) AS (
  SELECT list_id, min(n), 0, [min(n)] FROM pg GROUP BY 1
  UNION ALL SELECT w.list_id, l.nxt, place + 1, list_append(seen, l.nxt) FROM walk w JOIN led l ON l.list_id = w.list_id AND l.n = w.n WHERE l.nxt IS NOT NULL AND NOT list_contains(seen, l.nxt) AND place + 1 < 200),
e AS (SELECT r.*, place FROM r JOIN walk USING (list_id, n) QUALIFY row_number() OVER (PARTITION BY r.list_id, title_id ORDER BY place, row) = 1)
SELECT list_id, title_id, row, CAST(row_number() OVER (PARTITION BY list_id ORDER BY place, row) - 1 AS INT) AS pos FROM e""",
)
def list_walk(t: Tables) -> DataFrame:
    """Forty lists of staged pages; some lead back to their first page, and some to another host."""
    rows = t.table("orders").select((F.col("o_custkey") % 40).alias("list_id"), F.floor(F.col("o_orderkey") / 50).alias("n"), F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % 97).alias("title_id"))
    url = lambda n: F.concat(F.lit("https://api.example/list?offset="), n.cast("string"))
    numbers = rows.select("list_id", "n").distinct()
    w = Window.partitionBy("list_id").orderBy("n")
    order = numbers.select("list_id", "n", F.lead("n").over(w).alias("next"), F.row_number().over(w).alias("i"), F.min("n").over(Window.partitionBy("list_id")).alias("first"))
    back, away = (F.col("list_id") % 5 == 1) & (F.col("i") == 9), (F.col("list_id") % 5 == 2) & (F.col("i") == 7)
    led = F.when(back, url(F.col("first"))).when(away, F.concat(F.lit("https://evil.example/list?offset="), F.col("next").cast("string"))).otherwise(url(F.col("next")))
    pages = order.select("list_id", url(F.col("n")).alias("url"), led.alias("next"))
    walked = readers.page_walk(pages, order.where("n = first").select("list_id", url(F.col("n")).alias("url")))
    return readers.list_entries(walked, rows.withColumn("url", url(F.col("n")))).select("list_id", "title_id", "row", "pos")


@query(
    "S4_boundary",
    "",
    """WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 4 = 0 OR conv_id % 9 = 0 THEN 'airing' WHEN n < 5 THEN 'truncated' ELSE 'complete' END AS boundary FROM n""",
)
def boundaries(t: Tables) -> DataFrame:
    n = t.table("conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", readers.boundary(F.col("n"), F.when(F.col("conv_id") % 9 != 0, 5), F.col("conv_id") % 4 == 0).alias("boundary"))


@query("S5_broker_record", "titles", """SELECT title_id, CAST(title_id AS VARCHAR) AS id, 'anime' AS type, '2001-02-03' AS first_air_date, CASE WHEN ordinal % 2 = 0 THEN 'side_story' ELSE 'other' END AS kind, native AS external FROM titles""")
def broker(t: Tables) -> DataFrame:
    raw = F.concat(
        F.lit('{"id": '), F.col("title_id").cast("string"), F.lit(', "type": "ANIME", "title": "x", "first_air_date": "2001-02-03T10:00:00Z", "external_ids": {"mal": "'), "native", F.lit('"}, "relations": [{"kind": "'),
        F.when(F.col("ordinal") % 2 == 0, "Side Story").otherwise("Odd"), F.lit('", "to_id": 5}]}'),
    )
    r = t.titles().select("title_id", readers.broker_record(raw).alias("r"))
    return r.select("title_id", "r.id", "r.type", "r.first_air_date", F.col("r.relations")[0]["kind"].alias("kind"), F.col("r.external_ids")["mal"].alias("external"))


@query("S7_S8_anime_xml", "titles", """SELECT title_id, CAST(title_id AS VARCHAR) AS id, CASE WHEN ordinal % 2 = 0 THEN 'A & ' || title ELSE 'English' END AS title, CAST(2 AS BIGINT) AS n_episodes, '1,2' AS numbers, 'Studio' AS studio FROM titles""")
def xml(t: Tables) -> DataFrame:
    kind = F.when(F.col("ordinal") % 2 == 0, "main").otherwise("synonym")
    doc = F.concat(
        F.lit('<anime id="'), F.col("title_id").cast("string"), F.lit('"><titles><title type="'), kind, F.lit('" lang="ja">A &amp; '), "title",
        F.lit('</title><title type="official" lang="en">English</title></titles><episodes><episode><epno type="1">2</epno></episode><episode><epno type="2">S1</epno></episode><episode><epno type="1">1</epno></episode></episodes>'
              '<creators><name type="Animation Work">Studio</name><name type="Music">M</name></creators></anime>'),
    )
    r = t.spread(t.titles(), "title_id").select("title_id", readers.anime_record(doc).alias("r"))
    numbers = F.array_join(F.transform("r.episodes", lambda e: e["number"].cast("string")), ",")
    return r.select("title_id", "r.id", "r.title", F.size("r.episodes").cast("long").alias("n_episodes"), numbers.alias("numbers"), F.col("r.studios")[0].alias("studio"))


@query("S9_genres", "titles", "SELECT title_id, 'Drama,' || service AS genres FROM titles")
def genres(t: Tables) -> DataFrame:
    g = F.array(F.lit(" Drama "), F.col("service"), F.lit("Drama"), F.lit("  "), F.concat(F.lit(" "), "service"))
    return t.titles().select("title_id", F.array_join(readers.distinct_genres(g), ",").alias("genres"))


@query(
    "S11_snapshot_cache_K7",
    "titles",
    """+s AS (SELECT title_id AS key, ordinal % 3 AS version, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * ordinal AS expires_at, title AS payload FROM titles WHERE title_id % 2 = 0)
SELECT title_id AS key, payload FROM titles LEFT JOIN s ON s.key = title_id AND version = 1 AND expires_at > TIMESTAMP '2024-01-01 12:00:00'""",
)
def cache(t: Tables) -> DataFrame:
    x = t.titles()
    expires = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("ordinal"))
    s = x.where("title_id % 2 = 0").select(F.col("title_id").alias("key"), (F.col("ordinal") % 3).alias("version"), expires.alias("expires_at"), F.col("title").alias("payload"))
    hit, miss = readers.snapshot_hits(x.select(F.col("title_id").alias("key")), s, 1, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    return hit.select("key", "payload").unionByName(miss.select("key", F.lit(None).cast("string").alias("payload")))


@query(
    "S13_library_export",
    "progress statuses",
    f"+{ENTRIES} " + """SELECT user_id, '{"version":1,"exportedAt":"2024-02-01","works":[' || string_agg('{"work_id":' || work_id || ',"status":"' || status || '"' || CASE WHEN rating IS NULL THEN '' ELSE ',"rating":' || rating END || ',"watched":' || watched || '}', ',' ORDER BY work_id) || ']}' AS document
FROM entries GROUP BY 1""",
)
def export(t: Tables) -> DataFrame:
    return readers.library_export(entries(t), F.lit("2024-02-01"))


@query(
    "S15_schema_text",
    "",
    """SELECT 'N' || n_nationkey AS name, 'type N' || n_nationkey || ' implements R' || n_regionkey || ' {' || chr(10) || '  id: ID' || chr(10) || '  name: String' || chr(10) || '}' AS sdl FROM nation
UNION ALL SELECT 'R' || r_regionkey, 'interface R' || r_regionkey || ' {' || chr(10) || '  id: ID' || chr(10) || '  name: String' || chr(10) || '}' FROM region""",
)
def sdl(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    fields = F.array(F.struct(F.lit("id").alias("name"), F.lit("ID").alias("type")), F.struct(F.lit("name").alias("name"), F.lit("String").alias("type")))
    nation = t.table("nation")
    of = nation.groupBy("n_regionkey").agg(F.collect_list(name("N", "n_nationkey")).alias("possible"))
    faces = t.table("region").join(of, F.col("r_regionkey") == F.col("n_regionkey")).select(name("R", "r_regionkey").alias("name"), F.lit("INTERFACE").alias("kind"), "possible", fields.alias("fields"))
    objects = nation.select(name("N", "n_nationkey").alias("name"), F.lit("OBJECT").alias("kind"), F.array().cast("array<string>").alias("possible"), fields.alias("fields"))
    return readers.schema_text(faces.unionByName(objects))
