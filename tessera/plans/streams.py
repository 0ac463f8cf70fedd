"""Queries on streams: the events table is streamed, with a late or repeated delivery where a query is about that."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.registry import query
from tessera.sources.bindings import Tables
from tessera.streaming import events as s
from tessera.streaming import keyed
from tessera.streaming.snapshots import Snapshot


def folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one; a temporary one only in local mode, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/streams-{uuid.uuid4().hex}"


def streamed(t: Tables) -> DataFrame:
    return s.read(t.spark, t.sf_dir)


def last_of(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's row of the last batch that changed it."""
    values = [c for c in updates.columns if c not in (*keys, "_batch", "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("r"))
    return last.select(*keys, "r.*")


@query("K1_claim_once", "", "SELECT event_id, user_id FROM events")
def once(t: Tables) -> DataFrame:
    twice = streamed(t).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery")).drop("delivery")
    return s.drain(s.once(twice), folder(t.spark), "once").select("event_id", "user_id")


@query(
    "K2_stale_reactivation",
    "",
    """WITH RECURSIVE e AS (
  SELECT user_id, event_type = 'error' AS ends, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 2 AS sub,
    row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 7919) % 10007, event_id) AS n
  FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
f(user_id, n, status, sub, ignored) AS (
  SELECT user_id, 1, CASE WHEN ends THEN 'inactive' ELSE 'active' END, sub, CAST(0 AS BIGINT) FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, CASE WHEN e.ends OR (f.status = 'inactive' AND f.sub = e.sub) THEN 'inactive' ELSE 'active' END, e.sub,
    f.ignored + CASE WHEN NOT e.ends AND f.status = 'inactive' AND f.sub = e.sub THEN 1 ELSE 0 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, status, sub, ignored FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
)
def subscriptions(t: Tables) -> DataFrame:
    """Delivered out of order: by a scrambled event id, not by time."""
    sub = F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 2
    seq = (F.col("event_id") * 7919) % 10007 * 10**10 + F.col("event_id")
    out = s.drain(s.subscriptions(streamed(t).withColumns({"sub": sub, "seq": seq})), folder(t.spark), "subscriptions", "update")
    last = out.groupBy("user_id").agg(F.max(F.struct("_batch", "status", "sub", "ignored")).alias("r"))
    return last.select("user_id", "r.status", "r.sub", "r.ignored")


@query("K5_rate_limit_windows", "", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS start, user_id, count(*) AS n, count(*) > 2 AS over FROM events GROUP BY 1, 2")
def rates(t: Tables) -> DataFrame:
    out = last_of(s.drain(s.rate_windows(streamed(t), 2, "1 hour"), folder(t.spark), "rates", "update"), ["start", "user_id"])
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("K8_daily_buckets", "", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def days(t: Tables) -> DataFrame:
    return last_of(s.drain(s.daily(streamed(t)), folder(t.spark), "days", "update"), ["day", "event_type"])


@query(
    "K3_last_writer_wins",
    "ev",
    """+o AS (SELECT user_id, k % 10 AS key, event_id, ts, 1 AS old FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT user_id, k % 10, event_id, ts, 0 FROM ev WHERE event_id % 2 = 1)
SELECT user_id, key, event_id FROM o QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, old DESC, event_id DESC) = 1""",
)
def writers(t: Tables) -> DataFrame:
    """Two streams are merged into one table, the second one's older rows too late; the second is delivered twice."""
    e = streamed(t).select("user_id", (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 10).alias("key"), "event_id", "ts")
    table = Snapshot(t.spark, folder(t.spark), "user_id long, key int, event_id long, ts timestamp")
    for name, part in (("even", 0), ("odd", 1), ("odd-again", 1)):
        table.drain(e.where(F.col("event_id") % 2 == part), name, ["user_id", "key"], "ts", "event_id")
    return table.read().select("user_id", "key", "event_id")


@query(
    "K1_claims_released",
    "",
    """WITH e AS (SELECT event_id, 'deliver' AS action, 0 AS n FROM events UNION ALL SELECT event_id, 'deliver', 1 FROM events
  UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'release' ELSE 'complete' END, 2 FROM events UNION ALL SELECT event_id, 'deliver', 3 FROM events)
SELECT event_id, CAST(n AS BIGINT) AS seq, action, CASE n WHEN 0 THEN 'claimed' WHEN 1 THEN 'in_flight' WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN 'released' ELSE 'done' END
  ELSE CASE WHEN event_id % 3 = 0 THEN 'claimed' ELSE 'duplicate' END END AS result FROM e""",
)
def claims(t: Tables) -> DataFrame:
    """Each event is delivered three times; the first claim of a third of them is given up before the last."""
    ends = F.when(F.col("event_id") % 3 == 0, "release").otherwise("complete")
    log = streamed(t).select("event_id", F.posexplode(F.array(F.lit("deliver"), F.lit("deliver"), ends, F.lit("deliver"))).alias("seq", "action"), F.col("ts").alias("at"))
    return s.drain(keyed.claims(log.withColumn("seq", F.col("seq").cast("long"))), folder(t.spark), "claims").select("event_id", "seq", "action", "result")


@query(
    "K7_expiring_cache",
    "ev",
    """+l AS (SELECT user_id || '' AS key, CASE WHEN user_id % 2 = 0 THEN 'volatile' ELSE 'core' END AS kind, event_id AS seq, event_type = 'view' AS put, epoch_ms(ts) AS ms, rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ev),
g AS (SELECT *, max(CASE WHEN put THEN n END) OVER (PARTITION BY key ORDER BY n) AS last FROM l),
p AS (SELECT key, n, ms, seq FROM l WHERE put)
SELECT g.key, g.kind, CAST(g.n AS BIGINT) AS seq, coalesce(g.ms < p.ms + CASE kind WHEN 'core' THEN 604800000 ELSE 21600000 END, false) AS hit,
  CASE WHEN g.ms < p.ms + CASE kind WHEN 'core' THEN 604800000 ELSE 21600000 END THEN CAST(p.seq AS VARCHAR) END AS value
FROM g LEFT JOIN p ON p.key = g.key AND p.n = g.last WHERE NOT put""",
)
def expiring(t: Tables) -> DataFrame:
    """A user's views fill an entry, the other events read it; half of the entries are volatile."""
    e, w = t.events(), Window.partitionBy("user_id").orderBy("ts", "event_id")
    place = folder(t.spark)
    # numbered in the order of time first, as the log of a cache is
    e.select("event_id", F.rank().over(w).cast("long").alias("seq")).write.parquet(f"{place}/order")
    order = t.spark.read.parquet(f"{place}/order")
    log = streamed(t).join(order, "event_id").select(
        F.col("user_id").cast("string").alias("key"), F.when(F.col("user_id") % 2 == 0, "volatile").otherwise("core").alias("kind"), "seq", F.when(F.col("event_type") == "view", "put").otherwise("get").alias("action"),
        F.col("event_id").cast("string").alias("value"), F.col("ts").alias("at"),
    )
    return s.drain(keyed.cache(log), place, "cache").select("key", "kind", "seq", "hit", "value")
