"""Queries on scalar functions: text, identity, scales, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import identity, scores, text
from tessera.plans.registry import query
from tessera.sources.bindings import Tables

NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
TOKENS = "CASE WHEN {0} = '' THEN [] ELSE string_split({0}, ' ') END"
OVERLAP = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
SIMILAR = f"""CASE WHEN a = '' OR b = '' THEN 0.0 ELSE (1 - levenshtein(a, b) / greatest(length(a), length(b))) * 0.5 + ({OVERLAP.format('ta', 'tb')}) * 0.5 END"""


@query("X1_normalise_title_X2_tokens", "titles", f"SELECT title_id, {NORM.format(chr(39) + '  The ' + chr(39) + ' || title || ' + chr(39) + '! (II)' + chr(39))} AS normalised, len(string_split({NORM.format(chr(39) + '  The ' + chr(39) + ' || title || ' + chr(39) + '! (II)' + chr(39))}, ' ')) AS n_tokens FROM titles")
def normalised(t: Tables) -> DataFrame:
    n = text.normalise_title(F.concat(F.lit("  The "), "title", F.lit("! (II)")))
    return t.titles().select("title_id", n.alias("normalised"), F.size(text.tokens(n)).cast("long").alias("n_tokens"))


PAIRS = f"+p AS (SELECT x.title_id, y.title_id AS other_id, {NORM.format('x.title')} AS a, {NORM.format('y.title')} AS b FROM titles x JOIN titles y USING (group_id)), q AS (SELECT *, {TOKENS.format('a')} AS ta, {TOKENS.format('b')} AS tb FROM p)"


def pairs(t: Tables) -> DataFrame:
    """Pairs of titles of a group, with their normal forms (a, b) and words, which are made once a title."""
    x = t.spread(t.titles().select("group_id", "title_id", "title", "ordinal"), "group_id").withColumn("a", text.normalise_title(F.col("title")))
    x = x.select("group_id", "title_id", "ordinal", "a", text.tokens(F.col("a")).alias("a_words"))
    y = x.select("group_id", F.col("title_id").alias("other_id"), F.col("ordinal").alias("other_ordinal"), F.col("a").alias("b"), F.col("a_words").alias("b_words"))
    return x.join(y, "group_id")


def alike() -> Column:
    return text.words_similarity(F.col("a"), F.col("b"), F.col("a_words"), F.col("b_words"))


@query("X3_edit_distance_X4_title_similarity_A10_overlap", "titles", PAIRS + f" SELECT title_id, other_id, levenshtein(a, b) AS edits, round({OVERLAP.format('ta', 'tb')}, 6) AS overlap, round({SIMILAR}, 6) AS similarity FROM q")
def similarity(t: Tables) -> DataFrame:
    return pairs(t).select(
        "title_id", "other_id", F.levenshtein("a", "b").cast("long").alias("edits"), F.round(text.token_overlap(F.col("a_words"), F.col("b_words")), 6).alias("overlap"), F.round(alike(), 6).alias("similarity")
    )


@query(
    "X5_hit_score",
    "titles",
    PAIRS.replace("x.title_id, y.title_id AS other_id", "x.title_id, y.title_id AS other_id, CASE WHEN x.ordinal % 5 > 0 THEN 1990 + x.ordinal END AS ya, 1990 + y.ordinal AS yb")
    + f" SELECT title_id, other_id, round(CASE WHEN ya IS NULL OR yb IS NULL THEN s ELSE s * 0.6 + (CASE WHEN abs(ya - yb) <= 1 THEN 1 ELSE 0 END) * 0.4 END, 6) AS score FROM (SELECT *, {SIMILAR} AS s FROM q)",
)
def hits(t: Tables) -> DataFrame:
    year = F.when(F.col("ordinal") % 5 > 0, F.col("ordinal") + 1990)
    return pairs(t).select("title_id", "other_id", F.round(text.hit_score(alike(), year, F.col("other_ordinal") + 1990), 6).alias("score"))


@query(
    "X6_X7_X8_X9_X10_dates",
    "",
    """WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS a, CAST(DATE '1998-01-01' + CAST(o_orderkey % 700 AS INT) AS VARCHAR) AS b,
  CAST(o_orderkey % 13 AS INT) AS m FROM orders)
SELECT id, abs(date_diff('day', try_cast(a AS DATE), try_cast(b AS DATE))) AS gap, try_cast(substr(a, 1, 4) AS INT) AS year, CASE WHEN m > 0 THEN '2001-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-01' ELSE '2001-01-01' END AS assembled,
  CAST(CAST(to_timestamp(id * 86400) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR) AS epoch_day, CAST(CAST(b AS DATE) + 13 AS VARCHAR) AS until FROM d""",
)
def dates(t: Tables) -> DataFrame:
    i = F.col("o_orderkey")
    d = t.table("orders").select(
        i.alias("id"), F.when(i % 5 == 0, "soon").otherwise(F.to_date("o_orderdate").cast("string")).alias("a"), F.date_add(F.lit("1998-01-01").cast("date"), (i % 700).cast("int")).cast("string").alias("b"), (i % 13).cast("int").alias("m")
    )
    return d.select(
        "id",
        text.day_distance(F.col("a"), F.col("b")).cast("long").alias("gap"),
        text.year_of(F.col("a")).alias("year"),
        text.partial_date(F.lit(2001), F.when(F.col("m") > 0, F.col("m")), F.lit(None).cast("int")).alias("assembled"),
        text.iso_day(text.epoch_day(F.col("id") * 86400)).alias("epoch_day"),
        F.date_add(F.col("b").cast("date"), 13).cast("string").alias("until"),
    )


@query(
    "X12_runtime_bonus_X13_position_bonus",
    "",
    """WITH d AS (SELECT l_orderkey, l_partkey, l_linenumber, max(l_quantity) AS a, max(l_tax * 500 + 10) AS b, max(l_discount) AS p FROM lineitem GROUP BY 1, 2, 3)
SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN least(a, b) / greatest(a, b) <= 0.8 THEN 0 ELSE (least(a, b) / greatest(a, b) - 0.8) / (1 - 0.8) * 0.15 END, 6) AS runtime,
  round(CASE WHEN l_linenumber = 3 THEN 0 ELSE greatest(0, 1 - abs(p - a / 50)) * 0.05 END, 6) AS position FROM d""",
)
def bonuses(t: Tables) -> DataFrame:
    d = t.table("lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.max("l_quantity").alias("a"), F.max(F.col("l_tax") * 500 + 10).alias("b"), F.max("l_discount").alias("p"))
    return d.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.round(scores.runtime_bonus(F.col("a"), F.col("b")), 6).alias("runtime"),
        F.round(scores.position_bonus(F.col("p"), F.col("a") / 50, F.col("l_linenumber") == 3), 6).alias("position"),
    )


@query(
    "X14_X15_X17_score_scales",
    "ev",
    """+s AS (SELECT event_id, CAST(k AS DOUBLE) AS s, list_extract(['POINT_100', 'POINT_10', 'POINT_5', 'POINT_3', NULL], CAST(event_id % 5 + 1 AS INT)) AS f FROM ev),
m AS (SELECT *, CASE WHEN s <= 0 THEN NULL WHEN f = 'POINT_100' OR (f IS NULL AND s > 10) THEN greatest(1, floor(s / 10 + 0.5)) WHEN f = 'POINT_5' THEN floor(s * 2 + 0.5)
  WHEN f = 'POINT_3' THEN CASE WHEN s <= 1 THEN 3 WHEN s >= 3 THEN 9 ELSE 6 END ELSE s END AS score FROM s)
SELECT event_id, CAST(score AS DOUBLE) AS score, CAST(score * 10 AS DOUBLE) AS to_anilist, CAST(score AS DOUBLE) AS to_mal FROM m""",
)
def scales(t: Tables) -> DataFrame:
    form = F.element_at(F.array(*map(F.lit, ["POINT_100", "POINT_10", "POINT_5", "POINT_3", None])), (F.col("event_id") % 5 + 1).cast("int"))
    s = t.events().select("event_id", scores.imported_score(F.col("k").cast("double"), form).alias("score"))
    return s.select("event_id", "score", scores.exported_score(F.col("score"), F.lit("anilist")).alias("to_anilist"), scores.exported_score(F.col("score"), F.lit("mal")).alias("to_mal"))


@query(
    "X18_X19_X20_X22_X23_keys",
    "titles",
    """+d AS (SELECT title_id, CASE WHEN title_id < 36 THEN substr('0123456789abcdefghijklmnopqrstuvwxyz', title_id + 1, 1)
  ELSE ltrim(list_aggregate(list_transform([5, 4, 3, 2, 1, 0], lambda e: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((title_id // CAST(pow(36, e) AS BIGINT)) % 36 + 1 AS BIGINT), 1)), 'string_agg', ''), '0') END AS b, ordinal, service FROM titles)
SELECT title_id, 'pending:' || b AS ref, title_id AS back, lower(hex(encode('build' || chr(0) || service || chr(0) || title_id))) AS instance, least(title_id, ordinal) || ':' || greatest(title_id, ordinal) AS pair_key,
  sha256(service || title_id) AS secret_hash, CASE WHEN title_id % 3 = 0 THEN title_id END AS continuity FROM d""",
)
def keys(t: Tables) -> DataFrame:
    i = F.col("title_id")
    ref = text.opaque_ref("pending", i)
    key = F.when(i % 3 == 0, F.concat(F.lit("continuity:"), i.cast("string"))).when(i % 3 == 1, F.concat(F.lit("continuity:x"), i.cast("string"))).otherwise(F.concat(F.lit("continuity:"), i.cast("string"), F.lit(":1")))
    return t.titles().select(
        "title_id",
        ref.alias("ref"),
        text.ref_number(ref).alias("back"),
        text.instance_id(F.lit("build"), F.col("service"), i.cast("string")).alias("instance"),
        text.ordered_pair_key(i, F.col("ordinal").cast("long")).alias("pair_key"),
        F.sha2(F.concat("service", i.cast("string")), 256).alias("secret_hash"),
        text.continuity_number(key).alias("continuity"),
    )


@query(
    "A21_draft_fingerprint",
    "titles",
    """+c AS (SELECT title_id, native || title AS p FROM titles),
s AS (SELECT title_id, (2166136261 + CAST(list_sum(list_transform(range(1, length(p) + 1), lambda i: CAST(unicode(substr(p, i, 1)) AS BIGINT) * i)) AS BIGINT)) % 4294967291 AS h FROM c)
SELECT title_id, lpad(lower(to_hex(h)), 8, '0') AS fingerprint FROM s""",
)
def draft(t: Tables) -> DataFrame:
    return t.titles().select("title_id", text.payload_fingerprint(F.concat("native", "title")).alias("fingerprint"))


IDS = """+raw AS (SELECT title_id, list_extract(['anime', 'movie', 'series'], CAST(title_id % 3 + 1 AS INT)) AS profile,
  CASE WHEN service = 'imdb' THEN 'tt' || title_id WHEN title_id % 17 = 0 THEN 'plex:' || title_id WHEN title_id % 13 = 0 THEN service || ':x' || title_id ELSE service || ':' || title_id END
  || list_extract(['', ':3', ':1:4', ':2:5', ':a', ':1:2:3', ':1:b'], CAST(title_id % 7 + 1 AS INT)) AS raw FROM titles)"""


def ids(t: Tables) -> DataFrame:
    i, s = F.col("title_id"), F.col("service")
    text_id = i.cast("string")
    head = F.when(s == "imdb", F.concat(F.lit("tt"), text_id)).when(i % 17 == 0, F.concat(F.lit("plex:"), text_id)).when(i % 13 == 0, F.concat(s, F.lit(":x"), text_id)).otherwise(F.concat(s, F.lit(":"), text_id))
    tail = F.element_at(F.array(*map(F.lit, ["", ":3", ":1:4", ":2:5", ":a", ":1:2:3", ":1:b"])), (i % 7 + 1).cast("int"))
    profile = F.element_at(F.array(*map(F.lit, ["anime", "movie", "series"])), (i % 3 + 1).cast("int"))
    return t.titles().select("title_id", profile.alias("profile"), F.concat(head, tail).alias("raw"))


PARSED = IDS + """, p AS (SELECT *, string_split(raw, ':') AS parts FROM raw),
h AS (SELECT *, CASE WHEN regexp_matches(parts[1], '^tt[0-9]+$') THEN 'imdb' WHEN parts[1] IN ('anilist', 'kitsu', 'mal', 'tmdb', 'tvdb') THEN parts[1] END AS service,
  CASE WHEN regexp_matches(parts[1], '^tt[0-9]+$') THEN parts[1] ELSE parts[2] END AS native, CASE WHEN regexp_matches(parts[1], '^tt[0-9]+$') THEN parts[2:] ELSE parts[3:] END AS rest FROM p),
l AS (SELECT *, len(rest) AS n, service IN ('anilist', 'kitsu', 'mal') AS flat, CASE WHEN regexp_matches(rest[1], '^[0-9]+$') THEN CAST(rest[1] AS BIGINT) END AS one,
  CASE WHEN regexp_matches(rest[2], '^[0-9]+$') THEN CAST(rest[2] AS BIGINT) END AS two FROM h),
r AS (SELECT *, CASE WHEN n = 0 THEN NULL WHEN flat AND n = 1 THEN 1 ELSE one END AS season, CASE WHEN n = 0 THEN NULL WHEN flat AND n = 1 THEN one ELSE two END AS episode FROM l),
e AS (SELECT *, CASE WHEN service IS NULL THEN 'unrecognised-service' WHEN service <> 'imdb' AND NOT coalesce(regexp_matches(native, '^[0-9]+$'), false) THEN 'malformed-native-id'
  WHEN service = 'tmdb' AND profile = 'anime' THEN 'tmdb-not-in-anime' WHEN service <> 'tmdb' AND profile <> 'anime' AND service <> 'imdb' THEN 'service-not-in-profile'
  WHEN n = 0 THEN NULL WHEN profile = 'movie' THEN 'positional-not-allowed' WHEN n > 2 THEN 'extra-qualifier-segment' WHEN season IS NULL OR episode IS NULL THEN 'malformed-locator'
  WHEN flat AND season <> 1 THEN 'season-not-one' END AS reason FROM r)
"""


@query(
    "F1_parse_id_F4_admission",
    "titles",
    PARSED + """SELECT title_id, raw, reason, CASE WHEN reason IS NULL THEN service END AS service, CASE WHEN reason IS NULL AND service = 'tmdb' THEN CASE profile WHEN 'movie' THEN 'movie' ELSE 'tv' END END AS namespace,
  CASE WHEN reason IS NULL THEN native END AS id, CASE WHEN reason IS NULL THEN season END AS season, CASE WHEN reason IS NULL THEN episode END AS episode FROM e""",
)
def parsed(t: Tables) -> DataFrame:
    return ids(t).withColumn("p", identity.parse(F.col("profile"), F.col("raw"))).select("title_id", "raw", "p.reason", "p.service", "p.namespace", "p.id", "p.season", "p.episode")


@query(
    "F2_format_id_F3_graph_keys",
    "titles",
    PARSED + """SELECT title_id, CASE WHEN flat AND episode IS NOT NULL AND season + title_id % 2 <> 1 THEN NULL ELSE
    (CASE WHEN service = 'imdb' THEN native ELSE service || ':' || native END) || CASE WHEN episode IS NULL THEN '' WHEN flat THEN ':' || episode ELSE ':' || (season + title_id % 2) || ':' || episode END END AS id,
  CASE WHEN flat AND episode IS NOT NULL AND season + title_id % 2 <> 1 THEN 'flat-season-not-one' END AS error,
  CASE WHEN service = 'tmdb' THEN CASE profile WHEN 'movie' THEN 'movie:' ELSE 'tv:' END || native ELSE native END AS member, 's' || season || 'e' || episode AS locator FROM e WHERE reason IS NULL""",
)
def formatted(t: Tables) -> DataFrame:
    p = ids(t).withColumn("p", identity.parse(F.col("profile"), F.col("raw"))).where("p.reason IS NULL").select("title_id", "p.*")
    f = identity.format_id(F.col("service"), F.col("id"), F.col("season") + F.col("title_id") % 2, F.col("episode"))
    locator = identity.graph_locator(F.col("season"), F.col("episode"))
    return p.withColumn("f", f).select("title_id", F.col("f.id").alias("id"), F.col("f.error").alias("error"), identity.graph_member(F.col("service"), F.col("namespace"), F.col("id")).alias("member"), locator.alias("locator"))


_HOSTS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in identity.OFFICIAL_HOSTS.items()) + "}"


@query(
    "F13_official_host",
    "titles",
    f"""+hosts AS (SELECT {_HOSTS} AS m), u AS (
  SELECT title_id, CASE WHEN ordinal % 5 <> 0 THEN service END AS operator,
    CASE ordinal % 4 WHEN 0 THEN 'https://' || m[service][1] || '/' || native WHEN 1 THEN 'http://' || upper(m[service][2]) || ':80/x' WHEN 2 THEN 'https://' || m[service][1] || '.example.org/' ELSE 'https://' || m['mal'][1] END AS url
  FROM titles, hosts),
h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)) AS host FROM u)
SELECT title_id, host, coalesce(list_contains(CASE WHEN operator IS NULL THEN flatten(map_values(m)) ELSE m[operator] END, host), false) AS official FROM h, hosts""",
)
def official(t: Tables) -> DataFrame:
    hosts = F.create_map(*[x for k, v in identity.OFFICIAL_HOSTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = lambda n: F.get(F.try_element_at(hosts, F.col("service")), F.lit(n))
    k = F.col("ordinal") % 4
    url = (
        F.when(k == 0, F.concat(F.lit("https://"), own(0), F.lit("/"), F.col("native")))
        .when(k == 1, F.concat(F.lit("http://"), F.upper(own(1)), F.lit(":80/x")))
        .when(k == 2, F.concat(F.lit("https://"), own(0), F.lit(".example.org/")))
        .otherwise(F.lit("https://" + identity.OFFICIAL_HOSTS["mal"][0]))
    )
    operator = F.when(F.col("ordinal") % 5 != 0, F.col("service"))
    return t.titles().select("title_id", identity.host_of(url).alias("host"), identity.official_host(url, operator).alias("official"))


@query("X27_year_span_A13_run_sum", "titles", """+s AS (SELECT group_id, min(1980 + ordinal) AS a, max(CASE WHEN group_id % 3 > 0 THEN 1980 + ordinal END) AS b, CASE WHEN count(*) = count(CASE WHEN ordinal % 11 > 0 THEN ordinal END) THEN CAST(sum(ordinal) AS BIGINT) END AS total FROM titles GROUP BY 1)
SELECT group_id, CASE WHEN b IS NULL OR a = b THEN CAST(a AS VARCHAR) ELSE a || '–' || b END AS span, total FROM s""")
def year_spans(t: Tables) -> DataFrame:
    from tessera.operators.discovery import summed

    y = F.col("ordinal") + 1980
    s = t.titles().groupBy("group_id").agg(F.min(y).alias("a"), F.max(F.when(F.col("group_id") % 3 > 0, y)).alias("b"))
    total = summed(t.titles().select("group_id", F.when(F.col("ordinal") % 11 > 0, F.col("ordinal")).alias("size")), ["group_id"], "size")
    return s.join(total, "group_id").select("group_id", text.year_span(F.col("a"), F.col("b")).alias("span"), "total")
