"""Queries on tracking data."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scores, text
from tessera.operators import graph as g
from tessera.operators import tracker as k
from tessera.plans.registry import query
from tessera.sources.bindings import Tables

UNITS = "units AS (SELECT 'unit:' || i AS unit_key, 'unit:' || m AS member_key FROM (SELECT i, i AS m FROM range(60) t(i) UNION ALL SELECT i, i + 25 FROM range(60) t(i) WHERE i < 25 AND i % 2 = 0))"


def units(t: Tables) -> DataFrame:
    i = t.spark.range(60)
    name = lambda c: F.concat(F.lit("unit:"), c.cast("string"))
    own = i.select(name(F.col("id")).alias("unit_key"), name(F.col("id")).alias("member_key"))
    return own.unionByName(i.where("id < 25 AND id % 2 = 0").select(name(F.col("id")).alias("unit_key"), name(F.col("id") + 25).alias("member_key")))


@query(
    "A1_community_score",
    "ratings",
    f"+{UNITS}, " + """one AS (SELECT u.unit_key, r.user_id, r.score FROM units u JOIN ratings r ON r.unit_key = u.member_key
  QUALIFY row_number() OVER (PARTITION BY u.unit_key, r.user_id ORDER BY u.unit_key = u.member_key DESC, rating_id DESC) = 1)
SELECT u.unit_key, count(o.score) AS n_raters, avg(o.score) AS mean FROM (SELECT DISTINCT unit_key FROM units) u LEFT JOIN one o USING (unit_key) GROUP BY 1""",
)
def community(t: Tables) -> DataFrame:
    return k.community_scores(units(t), t.ratings())


ENTRIES = """seen AS (SELECT user_id, work_id, count(DISTINCT locator) AS watched FROM progress GROUP BY 1, 2),
entries AS (SELECT s.user_id, s.work_id, s.status, s.updated_at, CASE s.work_id % 3 WHEN 0 THEN 'anime' WHEN 1 THEN 'film' ELSE 'tv' END AS media_kind,
  CASE WHEN s.work_id % 4 <> 0 THEN CAST(s.work_id % 10 + 1 AS BIGINT) END AS rating, s.work_id % 2 AS rewatch_count, CAST(5 AS BIGINT) AS total, coalesce(watched, 0) AS watched,
  CASE WHEN s.work_id % 5 <> 0 THEN CAST(20 + s.work_id AS BIGINT) END AS runtime, CASE WHEN s.work_id % 7 <> 6 THEN 'Work ' || s.work_id END AS title
  FROM statuses s LEFT JOIN seen USING (user_id, work_id))"""


def entries(t: Tables) -> DataFrame:
    w = F.col("work_id")
    seen = t.progress().groupBy("user_id", "work_id").agg(F.countDistinct("locator").alias("watched"))
    return t.statuses().join(seen, ["user_id", "work_id"], "left").select(
        "user_id",
        "work_id",
        "status",
        "updated_at",
        F.when(w % 3 == 0, "anime").when(w % 3 == 1, "film").otherwise("tv").alias("media_kind"),
        F.when(w % 4 != 0, w % 10 + 1).alias("rating"),
        (w % 2).alias("rewatch_count"),
        F.lit(5).cast("long").alias("total"),
        F.coalesce("watched", F.lit(0)).alias("watched"),
        F.when(w % 5 != 0, w + 20).alias("runtime"),
        F.when(w % 7 != 6, F.concat(F.lit("Work "), w.cast("string"))).alias("title"),
    )


STATS = ",\n  ".join(
    ["count(*) AS n_works"]
    + [f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in scores.STATUSES]
    + [f"count(*) FILTER (WHERE media_kind = '{x}') AS n_{x}" for x in ("anime", "film", "tv")]
    + [
        "count(rating) AS n_rated",
        "floor(avg(rating) * 10 + 0.5) / 10 AS mean_rating",
        "CAST(sum(rewatch_count) AS BIGINT) AS rewatch_count",
        "CAST(sum(total) AS BIGINT) AS total_instalments",
        "CAST(sum(watched) AS BIGINT) AS watched_instalments",
        "CAST(coalesce(sum(watched * runtime), 0) AS BIGINT) AS watched_minutes",
        "bool_or(runtime IS NULL AND watched > 0) AS omitted_runtime",
    ]
)


@query("A2_library_stats", "progress statuses", f"+{ENTRIES} SELECT user_id, {STATS} FROM entries GROUP BY 1")
def stats(t: Tables) -> DataFrame:
    return k.library_stats(entries(t))


@query(
    "X11_watched_hours_X28_percent",
    "progress statuses",
    f"+{ENTRIES}, " + """m AS (SELECT user_id, CAST(coalesce(sum(watched * runtime), 0) AS BIGINT) AS minutes, bool_or(runtime IS NULL AND watched > 0) AS omitted, CAST(sum(watched) AS BIGINT) AS w, CAST(sum(total) AS BIGINT) AS n FROM entries GROUP BY 1)
SELECT user_id, (CASE WHEN minutes <= 0 THEN '0m' WHEN minutes < 60 THEN minutes || 'm' WHEN minutes % 60 = 0 THEN (minutes // 60) || 'h' ELSE (minutes // 60) || 'h ' || (minutes % 60) || 'm' END)
  || CASE WHEN omitted THEN ' · some titles omitted' ELSE '' END AS hours, CAST(CASE WHEN n = 0 THEN 0 ELSE floor(w * 100.0 / n + 0.5) END AS BIGINT) AS percent FROM m""",
)
def hours(t: Tables) -> DataFrame:
    s = k.library_stats(entries(t))
    return s.select(
        "user_id",
        text.watched_hours(F.col("watched_minutes"), F.col("omitted_runtime")).alias("hours"),
        text.percent(F.col("watched_instalments"), F.col("total_instalments")).alias("percent"),
    )


@query(
    "A3_watch_span_A4_derived_status",
    "progress works",
    """+need AS (SELECT work_id, count(DISTINCT locator) AS n FROM works GROUP BY 1),
s AS (SELECT user_id, w.work_id, min(watched_at) AS a, max(watched_at) AS b, count(DISTINCT w.locator) AS n_watched FROM works w JOIN progress p ON p.locator = w.locator GROUP BY 1, 2)
SELECT user_id, work_id, n_watched, CASE WHEN n_watched = n THEN 'completed' ELSE 'watching' END AS status, CAST(CAST(a AS DATE) AS VARCHAR) AS started_on, CASE WHEN n_watched = n THEN CAST(CAST(b AS DATE) AS VARCHAR) END AS finished_on
FROM s JOIN need USING (work_id)""",
)
def spans(t: Tables) -> DataFrame:
    days = k.watch_spans(t.works().select("work_id", "locator"), t.progress().drop("work_id"))
    return days.withColumns({c: F.col(c).cast("string") for c in ("started_on", "finished_on")})


PLAN = """plan AS (SELECT work_id, CAST(pos // 3 AS INT) AS segment_no, CAST(pos % 3 AS INT) AS pos, locator, CASE WHEN work_id % 6 = 0 THEN 'atomic' ELSE 'episodic' END AS kind,
  CASE WHEN work_id % 4 = 1 THEN 'Season' END AS label, CASE WHEN work_id % 3 = 0 THEN CAST(pos + 10 AS INT) END AS number, CASE WHEN pos % 2 = 0 THEN 'T' || pos END AS title FROM works)"""


def plan(t: Tables) -> DataFrame:
    w, p = F.col("work_id"), F.col("pos")
    return t.works().select(
        "work_id",
        F.floor(p / 3).cast("int").alias("segment_no"),
        (p % 3).alias("pos"),
        "locator",
        F.when(w % 6 == 0, "atomic").otherwise("episodic").alias("kind"),
        F.when(w % 4 == 1, "Season").alias("label"),
        F.when(w % 3 == 0, p + 10).alias("number"),
        F.when(p % 2 == 0, F.concat(F.lit("T"), p.cast("string"))).alias("title"),
    )


@query(
    "W7_next_up_W16_numbers",
    "progress statuses works",
    f"+{PLAN}, " + """left_ AS (SELECT s.user_id, p.* FROM statuses s JOIN plan p USING (work_id) WHERE status <> 'completed' AND NOT EXISTS (SELECT 1 FROM progress g WHERE g.user_id = s.user_id AND g.locator = p.locator)
  QUALIFY row_number() OVER (PARTITION BY s.user_id, p.work_id ORDER BY segment_no, pos) = 1)
SELECT user_id, work_id, locator, CAST(CASE WHEN kind = 'atomic' THEN 1 ELSE coalesce(number, pos + 1) END AS BIGINT) AS number,
  CASE WHEN kind = 'atomic' THEN 'Film' ELSE coalesce(label, 'Part ' || (segment_no + 1)) END AS part_label,
  CASE WHEN kind = 'atomic' THEN coalesce(label, 'Film') ELSE coalesce(title, 'Episode ' || coalesce(number, pos + 1)) END AS title FROM left_""",
)
def up_next(t: Tables) -> DataFrame:
    return k.next_up(plan(t), t.statuses(), t.progress())


CLAIMS = "claims AS (SELECT work_id, CAST(work_id AS INT) AS place, locator FROM works UNION ALL SELECT work_id + 100, CAST(work_id + 1 AS INT), locator FROM works WHERE work_id % 2 = 0)"
OWNED = "owned AS (SELECT locator, work_id FROM claims WHERE work_id % 5 <> 4 QUALIFY row_number() OVER (PARTITION BY locator ORDER BY place, work_id) = 1)"


def owned(t: Tables) -> DataFrame:
    w = t.works()
    claims = w.select("work_id", F.col("work_id").cast("int").alias("place"), "locator").unionByName(
        w.where("work_id % 2 = 0").select((F.col("work_id") + 100).alias("work_id"), (F.col("work_id") + 1).cast("int").alias("place"), "locator")
    )
    return k.owners(claims.where("work_id % 5 <> 4"))


@query("J24_locator_owner", "works", f"+{CLAIMS}, {OWNED} SELECT * FROM owned")
def locator_owner(t: Tables) -> DataFrame:
    return owned(t)


@query(
    "O1_O2_history_page",
    "progress works",
    f"+{CLAIMS}, {OWNED}, " + """after AS (SELECT id, locator, watched_at FROM progress WHERE watched_at < TIMESTAMP '2024-01-20 00:00:00' OR (watched_at = TIMESTAMP '2024-01-20 00:00:00' AND id < 6000)),
shown AS (SELECT id, a.locator, work_id, watched_at FROM after a JOIN owned o ON a.locator = o.locator ORDER BY watched_at DESC, id DESC LIMIT 50)
SELECT s.*, EXISTS (SELECT 1 FROM after a, (SELECT watched_at, id FROM shown ORDER BY watched_at, id LIMIT 1) l WHERE a.watched_at < l.watched_at OR (a.watched_at = l.watched_at AND a.id < l.id)) AS has_more FROM shown s""",
)
def page(t: Tables) -> DataFrame:
    return k.history_page(t.progress().drop("work_id", "user_id"), owned(t), 50, (datetime.datetime(2024, 1, 20), 6000))


@query(
    "R12_history_of_every_user",
    "progress works",
    f"+{CLAIMS}, {OWNED} " + """SELECT user_id, id, o.work_id, place FROM (SELECT p.user_id, p.id, o.work_id, CAST(row_number() OVER (PARTITION BY p.user_id ORDER BY watched_at DESC, id DESC) AS INT) AS place
  FROM progress p JOIN owned o ON p.locator = o.locator) o WHERE place <= 50""",
)
def histories(t: Tables) -> DataFrame:
    return k.history_all(t.progress().drop("work_id"), owned(t), 50).select("user_id", "id", "work_id", "place")


AIR = "episodes AS (SELECT CASE WHEN event_id % 9 = 0 THEN 'soon' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day, event_type AS title, k AS number, 'E' || k AS episode_title FROM ev WHERE event_type = 'signup')"


@query(
    "F9_A19_calendar_days_R13_O4",
    "ev",
    f"+{AIR} " + """SELECT CAST(day AS VARCHAR) AS day, string_agg(title || '/' || number || '/' || episode_title, ' ' ORDER BY title, number, episode_title) AS episodes, count(*) AS n_episodes
FROM (SELECT title, number, episode_title, try_cast(day AS DATE) AS day FROM episodes) WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-23' GROUP BY 1""",
)
def calendar(t: Tables) -> DataFrame:
    e = t.events().where("event_type = 'signup'").select(
        F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.to_date("ts").cast("string")).alias("day"), F.col("event_type").alias("title"), F.col("k").alias("number"), F.concat(F.lit("E"), F.col("k").cast("string")).alias("episode_title")
    )
    line = F.transform("episodes", lambda x: F.concat_ws("/", x["title"], x["number"].cast("string"), x["episode_title"]))
    return k.airing_days(e, F.lit("2024-01-10").cast("date")).select(F.col("day").cast("string").alias("day"), F.array_join(line, " ").alias("episodes"), "n_episodes")


@query(
    "A17_collapse_tracked_A18",
    "statuses",
    """+r AS (SELECT user_id, work_id AS key, CAST(floor(work_id / 2) * 2 AS BIGINT) AS survivor, status, epoch_ms(updated_at) AS activity, work_id AS id FROM statuses)
SELECT user_id, survivor, key, status FROM r QUALIFY row_number() OVER (PARTITION BY user_id, survivor ORDER BY key = survivor DESC, activity DESC, id) = 1""",
)
def collapsed(t: Tables) -> DataFrame:
    r = t.statuses().select(
        "user_id", F.col("work_id").alias("key"), (F.floor(F.col("work_id") / 2) * 2).alias("survivor"), "status", F.unix_millis(F.col("updated_at").cast("timestamp")).alias("activity"), F.col("work_id").alias("id")
    )
    return k.collapse_tracked(r).select("user_id", "survivor", "key", "status")


@query(
    "F8_library_filter",
    "progress statuses",
    f"+{ENTRIES} SELECT user_id, work_id, title FROM entries WHERE status = 'watching' AND media_kind = 'anime' AND contains(lower(title), 'ork 1')",
)
def filtered(t: Tables) -> DataFrame:
    return k.library_filter(entries(t), F.lit("watching"), F.lit("anime"), F.lit("  ORK 1 ")).select("user_id", "work_id", "title")


@query(
    "O3_library_sorts",
    "progress statuses",
    f"+{ENTRIES}, " + """named AS (SELECT * REPLACE (CASE work_id % 5 WHEN 1 THEN 'É' || title WHEN 2 THEN 'e' || lower(title) WHEN 3 THEN '' ELSE title END AS title) FROM entries)
SELECT user_id, work_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, work_id) AS INT) AS by_activity,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(title, '') = '', coalesce(title, '') COLLATE NOCASE.NOACCENT, work_id) AS INT) AS by_title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rating DESC NULLS LAST, work_id) AS INT) AS by_rating FROM named""",
)
def sorts(t: Tables) -> DataFrame:
    w, title = F.col("work_id") % 5, F.col("title")
    named = F.when(w == 1, F.concat(F.lit("É"), title)).when(w == 2, F.concat(F.lit("e"), F.lower(title))).when(w == 3, "").otherwise(title)
    return k.library_places(entries(t).withColumn("title", named))


@query(
    "F10_continue_watching",
    "progress statuses works",
    f"+{PLAN}, " + """open_ AS (SELECT s.*, EXISTS (SELECT 1 FROM plan p WHERE p.work_id = s.work_id AND NOT EXISTS (SELECT 1 FROM progress g WHERE g.user_id = s.user_id AND g.locator = p.locator)) AS more FROM statuses s)
SELECT user_id, work_id, place FROM (SELECT user_id, work_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, work_id) AS INT) AS place FROM open_ WHERE more AND status IN ('watching', 'rewatching'))
WHERE place <= 4""",
)
def resume(t: Tables) -> DataFrame:
    found = k.continue_watching(t.statuses(), k.next_up(plan(t), t.statuses(), t.progress()), 4)
    return found.select("user_id", "work_id", "place")


@query(
    "J23_import_match",
    "titles ev",
    """+e AS (SELECT event_id AS entry_id, list_extract(['anilist', 'imdb', 'kitsu', 'mal', 'tmdb', 'tvdb'], CAST(k % 6 + 1 AS INT)) AS service, CAST(k * 6 + k % 6 + (CASE WHEN event_id % 4 = 0 THEN 1000000 ELSE 0 END) AS VARCHAR) AS native FROM ev WHERE event_type = 'error'),
s AS (SELECT title_id, CAST(floor(title_id / 5) AS BIGINT) AS continuity_id FROM titles WHERE title_id % 4 <> 3 UNION ALL SELECT title_id, title_id FROM titles WHERE title_id % 8 = 0),
o AS (SELECT entry_id, bool_or(t.title_id IS NOT NULL) AS hit, count(DISTINCT continuity_id) AS n, min(continuity_id) AS one FROM e LEFT JOIN titles t USING (service, native) LEFT JOIN s ON s.title_id = t.title_id GROUP BY 1),
c AS (SELECT *, CASE WHEN NOT hit THEN 'no_service_title' WHEN n = 0 THEN 'no_continuity' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome FROM o)
SELECT entry_id, outcome, n AS n_continuities, CASE WHEN outcome = 'matched' THEN one END AS continuity_id FROM c""",
)
def imports(t: Tables) -> DataFrame:
    from tessera.sources.bindings import SERVICES

    x = t.titles()
    native = F.col("k") * 6 + F.col("k") % 6 + F.when(F.col("event_id") % 4 == 0, 1_000_000).otherwise(0)
    e = t.events().where("event_type = 'error'").select(F.col("event_id").alias("entry_id"), F.element_at(F.array(*map(F.lit, SERVICES)), F.col("k") % 6 + 1).alias("service"), native.cast("string").alias("native"))
    s = x.where("title_id % 4 <> 3").select("title_id", F.floor(F.col("title_id") / 5).cast("long").alias("continuity_id")).unionByName(
        x.where("title_id % 8 = 0").select("title_id", F.col("title_id").alias("continuity_id"))
    )
    return k.match_imports(e, x.select("title_id", "service", "native"), s)


REMOTE = """remote AS (SELECT user_id, CAST(k % 20 AS BIGINT) AS work_id, k % 20 AS continuity_id, CASE WHEN k % 7 = 0 THEN NULL ELSE epoch_ms(ts) END AS updated_ms, CASE WHEN k % 3 = 0 THEN NULL ELSE k % 12 END AS progress,
  CASE WHEN k % 5 = 0 THEN NULL ELSE k % 10 + 1 END AS score, CAST(event_id AS VARCHAR) AS external_id, ts FROM ev WHERE event_type = 'signup')"""
PREFER = "PARTITION BY user_id, continuity_id ORDER BY coalesce(updated_ms, -1) DESC, coalesce(progress, -1) DESC, coalesce(score, -1) DESC, external_id"


def remote(t: Tables) -> DataFrame:
    c = F.col("k")
    return t.events().where("event_type = 'signup'").select(
        "user_id", (c % 20).cast("long").alias("work_id"), (c % 20).alias("continuity_id"), F.when(c % 7 != 0, F.unix_millis(F.col("ts").cast("timestamp"))).alias("updated_ms"), F.when(c % 3 != 0, c % 12).alias("progress"),
        F.when(c % 5 != 0, c % 10 + 1).alias("score"), F.col("event_id").cast("string").alias("external_id"), "ts",
    )


@query("A15_collapse_imports", "ev", f"+{REMOTE} SELECT user_id, continuity_id, external_id, progress, score FROM remote QUALIFY row_number() OVER ({PREFER}) = 1")
def collapse(t: Tables) -> DataFrame:
    return k.collapse_imports(remote(t)).select("user_id", "continuity_id", "external_id", "progress", "score")


APPLIED = f"""{REMOTE}, best AS (SELECT * FROM remote QUALIFY row_number() OVER ({PREFER}) = 1),
plan AS (SELECT b.user_id, b.work_id, CASE WHEN s.updated_at > CASE WHEN b.updated_ms IS NOT NULL THEN b.ts END THEN 'skipped_newer' ELSE 'applied' END AS outcome, b.progress, b.score, s.work_id % 10 + 1 AS held
  FROM best b LEFT JOIN statuses s USING (user_id, work_id))"""


def applied(t: Tables) -> DataFrame:
    best = k.collapse_imports(remote(t)).select("user_id", "work_id", F.when(F.col("updated_ms").isNotNull(), F.col("ts")).alias("updated_at"), F.lit("watching").alias("status"), "progress", "score")
    local = t.statuses().select("user_id", "work_id", "updated_at", (F.col("work_id") % 10 + 1).cast("int").alias("score"))
    return k.apply_imports(local, best)


@query(
    "T13w_import_apply_F12",
    "ev statuses",
    f"+{APPLIED} SELECT user_id, work_id, outcome, CASE WHEN outcome = 'applied' THEN 'watching' END AS new_status, CASE WHEN outcome = 'applied' THEN progress END AS new_progress, CASE WHEN score IS DISTINCT FROM held THEN score END AS new_score FROM plan",
)
def apply_(t: Tables) -> DataFrame:
    return applied(t)


@query("A16_import_counters", "ev statuses", f"+{APPLIED} SELECT outcome, count(*) AS n, count(CASE WHEN score IS DISTINCT FROM held THEN score END) AS n_scores FROM plan GROUP BY 1")
def counters(t: Tables) -> DataFrame:
    return applied(t).groupBy("outcome").agg(F.count("*").alias("n"), F.count("new_score").alias("n_scores"))


SYNC = """+seg AS (SELECT work_id, CAST(pos // 3 AS INT) AS segment_no, work_id * 2 + pos // 3 AS title_id, CAST(pos % 3 AS INT) AS off, locator FROM works),
targets AS (SELECT title_id, service AS provider, native FROM titles WHERE service IN ('anilist', 'mal')),
prov AS (SELECT unnest(['anilist', 'mal']) AS provider),
parts AS (SELECT DISTINCT user_id, s.work_id, segment_no, s.title_id, status, v.provider, native FROM seg s JOIN statuses st ON st.work_id = s.work_id CROSS JOIN prov v LEFT JOIN targets t ON t.title_id = s.title_id AND t.provider = v.provider),
scores AS (SELECT user_id, 'w#' || (rating_id % 100) AS locator, score FROM ratings),
w AS (
  SELECT user_id, work_id, segment_no, provider, native, 'warning' AS kind, CAST(NULL AS BIGINT) AS episode, 'no_member_title' AS value FROM parts WHERE native IS NULL
  UNION ALL SELECT user_id, work_id, segment_no, provider, native, 'status', NULL, status FROM parts WHERE native IS NOT NULL
  UNION ALL SELECT DISTINCT p.user_id, p.work_id, p.segment_no, p.provider, native, 'progress', off + 1, 'watched' FROM parts p JOIN seg s USING (work_id, segment_no) JOIN progress g ON g.user_id = p.user_id AND g.locator = s.locator WHERE native IS NOT NULL
  UNION ALL SELECT p.user_id, p.work_id, p.segment_no, p.provider, native, 'rating', off + 1, CAST(CASE WHEN provider = 'anilist' THEN score * 10 ELSE score END AS VARCHAR)
    FROM parts p JOIN seg s USING (work_id, segment_no) JOIN scores r ON r.user_id = p.user_id AND r.locator = s.locator WHERE native IS NOT NULL)
"""


def sync(t: Tables) -> DataFrame:
    p = F.col("pos")
    seg = t.works().select("work_id", F.floor(p / 3).cast("int").alias("segment_no"), (F.col("work_id") * 2 + F.floor(p / 3)).alias("title_id"), (p % 3).alias("offset"), "locator")
    targets = t.titles().where("service IN ('anilist', 'mal')").select("title_id", F.col("service").alias("provider"), "native")
    scores = t.ratings().select("user_id", F.concat(F.lit("w#"), (F.col("rating_id") % 100).cast("string")).alias("locator"), "score")
    return k.sync_writes(seg, t.statuses().drop("updated_at"), t.progress().select("user_id", "locator"), scores, targets, ["anilist", "mal"])


@query("R15_sync_fan_out", "titles progress ratings statuses works", SYNC + "SELECT * FROM w")
def fan_out(t: Tables) -> DataFrame:
    return sync(t)


@query("A23_sync_counts", "titles progress ratings statuses works", SYNC + "SELECT provider, kind, count(*) AS n FROM w GROUP BY 1, 2")
def sync_counts(t: Tables) -> DataFrame:
    return sync(t).groupBy("provider", "kind").agg(F.count("*").alias("n"))


@query(
    "O7_interleave",
    "titles",
    """+a AS (SELECT title_id % 50 AS query_id, title_id, CAST(row_number() OVER (PARTITION BY title_id % 50 ORDER BY title_id) AS INT) AS place FROM titles WHERE service = 'tmdb'),
b AS (SELECT title_id % 50 AS query_id, title_id, CAST(row_number() OVER (PARTITION BY title_id % 50 ORDER BY title_id) AS INT) AS place FROM titles WHERE service = 'anilist'),
u AS (SELECT *, 0 AS list FROM a UNION ALL SELECT *, 1 FROM b)
SELECT query_id, title_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, list) AS INT) AS rank FROM u) WHERE rank <= 20""",
)
def merged_hits(t: Tables) -> DataFrame:
    of = lambda s: g.ranked(t.titles().where(F.col("service") == s).select((F.col("title_id") % 50).alias("query_id"), "title_id"), ["query_id"], ["title_id"], "place")
    return k.interleave(of("tmdb"), of("anilist"), ["query_id"], 20).select("query_id", "title_id", "rank")


@query(
    "O8_release_tail_T14w",
    "titles",
    """+rel AS (SELECT group_id AS order_id, title_id AS segment_id, ordinal AS pos FROM titles), cur AS (SELECT * FROM rel WHERE segment_id % 3 = 0),
u AS (SELECT *, 0 AS tail FROM (SELECT order_id, segment_id, -pos AS pos FROM cur) UNION ALL SELECT r.*, 1 FROM rel r ANTI JOIN cur c ON r.order_id = c.order_id AND r.segment_id = c.segment_id)
SELECT order_id, segment_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY tail, pos, segment_id) AS INT) AS place FROM u""",
)
def tails(t: Tables) -> DataFrame:
    rel = t.titles().select(F.col("group_id").alias("order_id"), F.col("title_id").alias("segment_id"), F.col("ordinal").alias("pos"))
    return k.in_order(rel.where("segment_id % 3 = 0").withColumn("pos", -F.col("pos")), rel)


@query(
    "U1_U2_U6_key_sets",
    "progress ratings works",
    """+known AS (SELECT DISTINCT locator FROM works WHERE work_id % 4 <> 3), used AS (SELECT user_id, locator FROM progress UNION SELECT user_id, 'w#' || (score * 9) FROM ratings)
SELECT user_id, count(*) AS n_used, count(*) FILTER (WHERE locator IN (SELECT locator FROM known)) AS n_owned, count(*) FILTER (WHERE locator NOT IN (SELECT locator FROM known)) AS n_unknown FROM used GROUP BY 1""",
)
def key_sets(t: Tables) -> DataFrame:
    known = t.works().where("work_id % 4 <> 3").select("locator", F.lit(1).alias("_known")).distinct()
    used = t.progress().select("user_id", "locator").unionByName(t.ratings().select("user_id", F.concat(F.lit("w#"), (F.col("score") * 9).cast("string")).alias("locator"))).distinct()
    return used.join(known, "locator", "left").groupBy("user_id").agg(
        F.count("*").alias("n_used"), F.count("_known").alias("n_owned"), F.count_if(F.col("_known").isNull()).alias("n_unknown")
    )


@query(
    "J25_segment_metadata",
    "works",
    """+meta AS (SELECT work_id, pos, 'Title ' || work_id || '.' || pos AS title, CAST(pos * 2 + 1 AS INT) AS number FROM works WHERE (work_id + pos) % 3 <> 0)
SELECT w.work_id, w.pos, coalesce(number, w.pos + 1) AS number, coalesce(title, 'Episode ' || coalesce(number, w.pos + 1)) AS title FROM works w LEFT JOIN meta m ON m.work_id = w.work_id AND m.pos = w.pos""",
)
def metadata(t: Tables) -> DataFrame:
    w = t.works().select("work_id", "pos")
    meta = w.where("(work_id + pos) % 3 <> 0").withColumn("title", F.concat(F.lit("Title "), F.col("work_id").cast("string"), F.lit("."), F.col("pos").cast("string"))).withColumn("number", F.col("pos") * 2 + 1)
    number = F.coalesce("number", F.col("pos") + 1)
    return w.join(meta, ["work_id", "pos"], "left").select("work_id", "pos", number.alias("number"), F.coalesce("title", F.concat(F.lit("Episode "), number.cast("string"))).alias("title"))


@query(
    "A11_votes_R14_rating_list",
    "titles",
    """+b AS (SELECT l_partkey AS title_id, CAST(floor(l_quantity / 10) AS INT) AS bucket, count(*) AS amount FROM lineitem WHERE l_partkey % 9 <> 4 GROUP BY 1, 2),
v AS (SELECT title_id, CAST(sum(amount) AS BIGINT) AS votes FROM b GROUP BY 1)
SELECT title_id, CAST(score AS DOUBLE) AS score, votes FROM (SELECT title_id, coalesce(CASE WHEN title_id % 3 > 0 THEN ordinal - 5 END, CASE WHEN title_id % 5 > 0 THEN ordinal + 0.5 END) AS score FROM titles) JOIN v USING (title_id) WHERE score > 0 AND votes > 0""",
)
def votes(t: Tables) -> DataFrame:
    i, o = F.col("title_id"), F.col("ordinal")
    buckets = t.table("lineitem").where("l_partkey % 9 <> 4").groupBy(F.col("l_partkey").alias("title_id"), F.floor(F.col("l_quantity") / 10).cast("int").alias("bucket")).agg(F.count("*").alias("amount"))
    records = t.titles().select(i, F.when(i % 3 > 0, (o - 5).cast("double")).alias("average"), F.when(i % 5 > 0, o + F.lit(0.5)).alias("mean"))
    return k.bucketed_ratings(records, buckets)


@query(
    "R14_service_rating_list",
    "titles",
    """+r AS (SELECT group_id AS unit_id, service, title_id AS seq, ordinal AS score, title_id % 100 AS votes FROM titles),
o AS (SELECT *, list_position(['tmdb', 'imdb', 'metacritic', 'mal', 'anilist', 'anidb'], service) AS at_ FROM r WHERE service IN ('tmdb', 'imdb', 'metacritic', 'mal', 'anilist', 'anidb') QUALIFY row_number() OVER (PARTITION BY unit_id, service ORDER BY seq DESC) = 1)
SELECT unit_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY at_) AS INT) AS place, service, score, CASE WHEN service IN ('metacritic', 'anilist') THEN 100 ELSE 10 END AS scale, votes FROM o""",
)
def rating_list(t: Tables) -> DataFrame:
    """A group's titles are what the services wrote of one unit, in order of their ids."""
    i = F.col("title_id")
    return k.rating_list(t.titles().select(F.col("group_id").alias("unit_id"), "service", i.alias("seq"), F.col("ordinal").alias("score"), (i % 100).alias("votes")))
