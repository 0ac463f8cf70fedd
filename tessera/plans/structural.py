"""Queries on structural discovery: conversations are titles, five neighbours are found by the first one's ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import structural as s
from tessera.plans.registry import query
from tessera.sources.bindings import Tables

FOUND = """all_ AS (SELECT DISTINCT conv_id AS ref, conv_id - conv_id % 5 AS shared, CAST(conv_id // 5 AS BIGINT) AS group_id,
    CASE WHEN conv_id % 13 = 6 THEN NULL WHEN conv_id % 5 = 0 THEN 'airing' WHEN conv_id % 11 = 0 THEN 'truncated' ELSE 'complete' END AS boundary,
    CASE WHEN conv_id % 6 = 2 THEN NULL WHEN conv_id % 6 = 4 THEN DATE '2024-01-08' ELSE DATE '2024-01-01' + CAST(conv_id * 7 % 20 AS INT) END AS day FROM conversations),
members AS (SELECT * FROM all_ WHERE ref <> shared AND ref % 7 <> 3 AND group_id % 9 <> 4 AND shared IN (SELECT ref FROM all_)),
sized AS (SELECT a.group_id, 2 + a.group_id % 4 AS budget, count(m.ref) AS n_members, coalesce(bool_and(m.boundary <> 'truncated' AND m.boundary IS NOT NULL), true) AND bool_and(a.boundary IS NOT NULL AND a.boundary <> 'truncated') AS able,
    count(*) FILTER (WHERE m.ref IS NOT NULL AND (coalesce(m.day, DATE '9999-01-01') < coalesce(a.day, DATE '9999-01-01') OR m.day IS NOT DISTINCT FROM a.day AND CAST(m.ref AS VARCHAR) < CAST(a.ref AS VARCHAR))) AS before
  FROM all_ a LEFT JOIN members m ON m.shared = a.ref WHERE a.ref = a.shared GROUP BY 1, 2)"""


def titles(t: Tables) -> DataFrame:
    c = F.col("conv_id")
    # the streams of the ladder, one a title
    rows = t.table("conversations").select("conv_id", "turn", "text")
    n = F.length("text")
    shown = F.when(c % 6 == 2, F.when(c % 4 == 0, "soon")).when(c % 6 == 4, "2024-01-08").otherwise(F.date_add(F.lit("2024-01-01").cast("date"), (c * 7 % 20).cast("int")).cast("string"))
    boundary = F.when(c % 13 == 6, F.lit(None).cast("string")).when(c % 5 == 0, "airing").when(c % 11 == 0, "truncated").otherwise("complete")
    return rows.select(
        c.alias("ref"), F.lit("catalogue").alias("service"), c.cast("string").alias("native"), shown.alias("first_air_date"), boundary.alias("boundary"), F.col("turn").cast("int").alias("pos"),
        F.concat(F.lit("c"), c.cast("string"), F.lit("e"), (F.col("turn") + 1).cast("string")).alias("locator"), F.when(n % 7 == 0, "special").otherwise("regular").alias("kind"),
        F.when(n % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn") * 7 / 2).cast("int")).cast("string")).alias("air_date"),
        F.when(n % 3 != 0, (n % 40 + 20).cast("double")).alias("runtime"), F.when(n % 5 != 0, F.concat(F.lit("Part "), F.col("turn").cast("string"), F.lit("!"))).alias("title"),
    )


def discovered(t: Tables) -> s.Discovered:
    rows = titles(t)
    refs = rows.select("ref", "service", "native", "first_air_date", "boundary").distinct()
    shared = (F.col("ref") - F.col("ref") % 5).alias("names")
    group = F.floor(F.col("ref") / 5).cast("long")
    requests = refs.where("ref % 5 = 0").select(group.alias("group_id"), "ref", (2 + group % 4).alias("budget"))
    found = refs.where("floor(ref / 5) % 9 <> 4").select(shared.alias("ref"), F.col("ref").alias("candidate"))
    named = refs.where("ref % 7 <> 3").select("ref", shared)
    return s.discover(requests, found, named, refs, rows.drop("service", "native", "first_air_date", "boundary"))


@query(
    "D6_structural_discovery",
    "titles",
    f"+{FOUND} " + """SELECT group_id, n_members, CASE WHEN n_members = 0 THEN 'no-group' WHEN n_members + 1 > budget THEN 'over-budget' WHEN able THEN 'discovered' ELSE 'unmappable-member' END AS outcome,
  CASE WHEN n_members > 0 AND n_members + 1 <= budget AND able THEN CAST(before AS INT) END AS anchor_ordinal FROM sized""",
)
def outcomes(t: Tables) -> DataFrame:
    return discovered(t).groups


#: Members see what earlier members left, which SQL can't express; ``tests/test_structural.py`` tests it against plain loops.
@query("M11_member_mapping")
def member_pairs(t: Tables) -> DataFrame:
    found = discovered(t).pairs
    return found.select("group_id", "ref", "ordinal", F.concat_ws(" ", "shared").alias("shared"), F.concat_ws(" ", "member").alias("member"), "confidence")
