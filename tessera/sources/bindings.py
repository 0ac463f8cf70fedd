"""Domain relations over the driver tables. ``SQL`` holds the same relations as common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scores import STATUSES
from tessera.operators.graph import dealt

#: The catalogues.
SERVICES = ["anilist", "imdb", "kitsu", "mal", "tmdb", "tvdb"]
#: Lines that a task takes at most on average, so that its memory doesn't grow with the table.
LINES = 250_000


class Tables:
    """Lazily read driver tables and the relations made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame, key: str) -> DataFrame:
        """df dealt by a key to all tasks of a shuffle, however few its file is read by or its bytes would fill: before costly expressions."""
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)

    @cached_property
    def tasks(self) -> int | None:
        """How many tasks lines are dealt to; none where they are few, which Spark may put together as it likes. Parquet's footers give the count."""
        wanted = -(-self.table("lineitem").count() // LINES)
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), wanted) if wanted > self.spark.sparkContext.defaultParallelism else None

    def titles(self) -> DataFrame:
        """title_id, group_id, service, ordinal, title, native: a part is a title; eight neighbours are a group."""
        service = F.element_at(F.array(*map(F.lit, SERVICES)), (F.col("p_partkey") % 6 + 1).cast("int"))
        native = F.when(service == "tmdb", F.concat(F.when(F.col("p_partkey") % 4 == 0, F.lit("movie:")).otherwise(F.lit("tv:")), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string"))
        return self.table("part").select(
            F.col("p_partkey").alias("title_id"),
            F.floor(F.col("p_partkey") / 8).cast("long").alias("group_id"),
            service.alias("service"),
            F.col("p_size").alias("ordinal"),
            F.col("p_name").alias("title"),
            native.alias("native"),
        )

    def titles_with_anidb(self) -> DataFrame:
        """The titles with AniDB in TVDB's place."""
        return self.titles().withColumn("service", F.when(F.col("service") == "tvdb", "anidb").otherwise(F.col("service")))

    def edges(self, *of_titles: str) -> DataFrame:
        """title_id, service, unit_id, confidence, provenance, edge_id: an order is a unit that its parts cover. of_titles: further columns of titles."""
        lines = self.table("lineitem").select("l_partkey", "l_orderkey", "l_returnflag", "l_linenumber")
        # dealt by the part alone, by which the titles join: so they are not moved again where the titles are too many for a broadcast
        edges = dealt(lines, self.tasks, "l_partkey").groupBy("l_partkey", "l_orderkey").agg(
            F.min(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("confidence"), F.min("l_linenumber").alias("provenance")
        )
        titles = self.titles().select("title_id", "service", *of_titles)
        # a broadcast is built on the driver, and a table of titles is much larger there than its file tells
        titles = titles.hint("shuffle_hash") if self.tasks else titles
        return edges.join(titles, F.col("l_partkey") == F.col("title_id")).select(
            "title_id", "service", F.col("l_orderkey").alias("unit_id"), "confidence", "provenance", (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("edge_id"), *of_titles
        )

    def events(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        return self.table("events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))

    def progress(self) -> DataFrame:
        """id, user_id, work_id, locator, pos, watched_at: a view or click on k is an instalment of work k / 5."""
        e = self.events().where(F.col("event_type").isin("view", "click"))
        return e.select(
            F.col("event_id").alias("id"), "user_id", F.floor(F.col("k") / 5).cast("long").alias("work_id"), F.concat(F.lit("w#"), F.col("k").cast("string")).alias("locator"), F.col("ts").alias("watched_at")
        )

    def ratings(self) -> DataFrame:
        """rating_id, user_id, unit_key, score, at: the latest purchase of each user and unit."""
        e = self.events().where("event_type = 'purchase'").select(
            "user_id", F.concat(F.lit("unit:"), (F.col("k") % 50).cast("string")).alias("unit_key"), F.struct("ts", "event_id", (F.col("k") % 10 + 1).alias("score")).alias("r")
        )
        last = e.groupBy("user_id", "unit_key").agg(F.max("r").alias("r"))
        return last.select(F.col("r.event_id").alias("rating_id"), "user_id", "unit_key", F.col("r.score").alias("score"), F.col("r.ts").alias("at"))

    def statuses(self) -> DataFrame:
        """user_id, work_id, status, updated_at: by the latest event of each user and work."""
        status = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("r.k") % 6 + 1)
        last = self.events().groupBy("user_id", F.floor(F.col("k") / 5).cast("long").alias("work_id")).agg(F.max(F.struct("ts", "event_id", "k")).alias("r"))
        return last.select("user_id", "work_id", status.alias("status"), F.col("r.ts").alias("updated_at"))

    def works(self) -> DataFrame:
        """work_id, locator, pos: works of five instalments each, one instalment for every number that an order's key leaves
        when divided by 100 (events are on works of these numbers)."""
        k = self.table("orders").select((F.col("o_orderkey") % 100).cast("long").alias("k")).distinct()
        return k.select(F.floor(F.col("k") / 5).cast("long").alias("work_id"), F.concat(F.lit("w#"), F.col("k").cast("string")).alias("locator"), (F.col("k") % 5).cast("int").alias("pos"))

    def stream(self) -> DataFrame:
        """Streams of conversations: pair_id is two neighbours' conv_id / 2, the even one on the left."""
        c = self.table("conversations").select("conv_id", "turn", "text")
        n = F.length("text")
        return c.select(
            F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"),
            F.when(F.col("conv_id") % 2 == 0, "left").otherwise("right").alias("side"),
            F.col("turn").cast("int").alias("pos"),
            F.concat(F.lit("s1e"), (F.col("turn") + 1).cast("string")).alias("locator"),
            F.when(n % 7 == 0, "special").otherwise("regular").alias("kind"),
            F.when(F.col("conv_id") % 5 == 0, "airing").when(F.col("conv_id") % 11 == 0, "truncated").otherwise("complete").alias("boundary"),
            F.when(n % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn") * 7 / 2).cast("int")).cast("string")).alias("air_date"),
            F.when(n % 3 != 0, (n % 40 + 20).cast("double")).alias("runtime"),
            F.when(n % 5 != 0, F.concat(F.lit("Part "), F.col("turn").cast("string"), F.lit("!"))).alias("title"),
        )


#: The relations in SQL, by name; each needs only the driver tables and those named before it.
SQL = {
    "titles": """titles AS (
  SELECT p_partkey AS title_id, CAST(floor(p_partkey / 8) AS BIGINT) AS group_id, s AS service, p_size AS ordinal, p_name AS title,
    CASE WHEN s = 'tmdb' THEN (CASE WHEN p_partkey % 4 = 0 THEN 'movie:' ELSE 'tv:' END) || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS native
  FROM (SELECT *, list_extract(['anilist', 'imdb', 'kitsu', 'mal', 'tmdb', 'tvdb'], CAST(p_partkey % 6 + 1 AS INT)) AS s FROM part))""",
    "anidb": "anidb AS (SELECT * REPLACE (CASE WHEN service = 'tvdb' THEN 'anidb' ELSE service END AS service) FROM titles)",
    "edges": """edges AS (
  SELECT title_id, service, l_orderkey AS unit_id, min(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS confidence, min(l_linenumber) AS provenance,
    l_orderkey * 1000000 + l_partkey AS edge_id
  FROM lineitem JOIN titles ON title_id = l_partkey GROUP BY title_id, service, l_orderkey, l_partkey)""",
    "ev": "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)",
    "progress": """progress AS (
  SELECT event_id AS id, user_id, CAST(floor(k / 5) AS BIGINT) AS work_id, 'w#' || k AS locator, ts AS watched_at FROM ev WHERE event_type IN ('view', 'click'))""",
    "ratings": """ratings AS (
  SELECT event_id AS rating_id, user_id, unit_key, score, ts AS at FROM (
    SELECT *, 'unit:' || (k % 50) AS unit_key, k % 10 + 1 AS score FROM ev WHERE event_type = 'purchase')
  QUALIFY row_number() OVER (PARTITION BY user_id, unit_key ORDER BY ts DESC, event_id DESC) = 1)""",
    "statuses": """statuses AS (
  SELECT user_id, work_id, list_extract(['watching', 'plan_to_watch', 'on_hold', 'completed', 'dropped', 'rewatching'], k % 6 + 1) AS status, ts AS updated_at
  FROM (SELECT *, CAST(floor(k / 5) AS BIGINT) AS work_id FROM ev)
  QUALIFY row_number() OVER (PARTITION BY user_id, work_id ORDER BY ts DESC, event_id DESC) = 1)""",
    "works": "works AS (SELECT CAST(floor(k / 5) AS BIGINT) AS work_id, 'w#' || k AS locator, CAST(k % 5 AS INT) AS pos FROM (SELECT DISTINCT o_orderkey % 100 AS k FROM orders))",
    "stream": """stream AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, CAST(turn AS INT) AS pos,
    's1e' || (turn + 1) AS locator, CASE WHEN n % 7 = 0 THEN 'special' ELSE 'regular' END AS kind,
    CASE WHEN conv_id % 5 = 0 THEN 'airing' WHEN conv_id % 11 = 0 THEN 'truncated' ELSE 'complete' END AS boundary,
    CASE WHEN n % 4 <> 0 THEN CAST(DATE '2024-01-01' + CAST(trunc(turn * 7 / 2) AS INT) AS VARCHAR) END AS air_date,
    CASE WHEN n % 3 <> 0 THEN CAST(n % 40 + 20 AS DOUBLE) END AS runtime, CASE WHEN n % 5 <> 0 THEN 'Part ' || turn || '!' END AS title
  FROM (SELECT *, length(text) AS n FROM conversations))""",
}
NEEDS = {"edges": ["titles"], "anidb": ["titles"], "progress": ["ev"], "ratings": ["ev"], "statuses": ["ev"]}


def with_relations(names: str, body: str) -> str:
    """SQL of a query over the named relations."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [x for x in [*NEEDS.get(name, []), name] if x not in wanted]
    recursive = "RECURSIVE " if "/*recursive*/" in body else ""
    return f"WITH {recursive}" + ",\n".join(SQL[n] for n in wanted) + ("," if body.lstrip().startswith("+") else "") + "\n" + body.lstrip().removeprefix("+")
