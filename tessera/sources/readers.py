"""Readers of catalogue records: XML and JSON into declared schemas, paging, snapshots, and text out of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANIME_XML = (
    "STRUCT<_id: STRING, type: STRING, episodecount: STRING, startdate: STRING, titles: STRUCT<title: ARRAY<STRUCT<_VALUE: STRING, _type: STRING, _lang: STRING>>>,"
    " episodes: STRUCT<episode: ARRAY<STRUCT<epno: STRUCT<_VALUE: STRING, _type: STRING>, length: STRING, airdate: STRING>>>,"
    " creators: STRUCT<name: ARRAY<STRUCT<_VALUE: STRING, _type: STRING>>>>"
)
BROKER_JSON = "STRUCT<id: STRING, type: STRING, title: STRING, first_air_date: STRING, external_ids: MAP<STRING, STRING>, relations: ARRAY<STRUCT<kind: STRING, to_id: STRING>>>"
#: How relation kinds of a broker are known.
RELATIONS = ["sequel", "prequel", "side_story", "alternative", "summary", "spin_off"]


def anime_record(xml: Column) -> Column:
    """Work record of an anime document: title (main, else English, else the first), regular episodes in order, staff and studios."""
    # transform over one element binds the parsed document to a name, so that it is parsed once and not for every field
    return F.get(F.transform(F.array(F.from_xml(xml, ANIME_XML)), _anime_record), F.lit(0))


def _anime_record(x: Column) -> Column:
    titles = F.coalesce(x["titles"]["title"], F.array().cast("array<struct<_VALUE:string,_type:string,_lang:string>>"))
    pick = lambda test: F.get(F.filter(titles, test), F.lit(0))["_VALUE"]
    title = F.coalesce(pick(lambda t: t["_type"] == "main"), pick(lambda t: t["_lang"] == "en"), F.get(titles, F.lit(0))["_VALUE"])
    regular = F.filter(x["episodes"]["episode"], lambda e: e["epno"]["_type"] == "1")
    numbers = F.sort_array(F.transform(regular, lambda e: F.struct(e["epno"]["_VALUE"].try_cast("int").alias("number"), e["airdate"].alias("air_date"), e["length"].try_cast("int").alias("minutes"))))
    names = x["creators"]["name"]
    studio = lambda c: c["_type"] == "Animation Work"
    return F.struct(
        x["_id"].alias("id"),
        title.alias("title"),
        numbers.alias("episodes"),
        F.transform(F.filter(names, studio), lambda c: c["_VALUE"]).alias("studios"),
        F.slice(F.transform(F.filter(names, lambda c: ~studio(c)), lambda c: c["_VALUE"]), 1, 30).alias("staff"),
    )


def broker_record(text: Column) -> Column:
    """Normalised broker entry: ids as text, relation kinds in lower case with underscores (others: other), dates cut to the day."""
    x = F.from_json(text, BROKER_JSON)
    kind = lambda r: F.lower(F.regexp_replace(F.trim(r["kind"]), r"[\s-]+", "_"))
    relations = F.transform(x["relations"], lambda r: F.struct(F.when(kind(r).isin(RELATIONS), kind(r)).otherwise("other").alias("kind"), r["to_id"].alias("to_id")))
    return F.struct(x["id"].alias("id"), F.lower(x["type"]).alias("type"), x["title"].alias("title"), F.substring(x["first_air_date"], 1, 10).alias("first_air_date"), x["external_ids"].alias("external_ids"), relations.alias("relations"))


def distinct_genres(genres: Column, most: int = 8) -> Column:
    """Trimmed genres, each once in their order, at most ``most``."""
    return F.slice(F.array_distinct(F.filter(F.transform(genres, lambda g: F.trim(g)), lambda g: g != "")), 1, most)


def boundary(fetched: Column, claimed: Column, releasing: Column) -> Column:
    """Boundary of an enumerated stream: airing while released or of unknown length; cut short if fewer came than claimed."""
    return F.when(releasing | claimed.isNull(), "airing").when(fetched < claimed, "truncated").otherwise("complete")


def paged(rows: DataFrame, keys: list[str], most_pages: int = 100) -> DataFrame:
    """Rows of staged pages as one stream a key: pages up to the first missing one and the cap, in order. rows: page, row.

    A page counts if all pages before it are there, that is if its number is the count of pages up to it."""
    from pyspark.sql.window import Window

    pages = rows.where(F.col("page") <= most_pages).select(*keys, "page").distinct()
    whole = pages.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("page"))).where("page = _n").drop("_n")
    return rows.join(whole, [*keys, "page"]).withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("page", "row")) - 1)


def page_walk(pages: DataFrame, starts: DataFrame, most_pages: int = 200) -> DataFrame:
    """list_id, url, place: the staged pages of each list in the order in which they lead to one another.

    A walk ends where a page names no next one, names one of another origin or one that isn't staged, comes back to a page it has read, or
    has read ``most_pages``. Walks double with every round, and only until they hold that many. pages: list_id, url, next; starts:
    list_id, url."""
    from tessera.operators.discovery import cut, walk

    origin = lambda url: F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    begun = starts.select("list_id", "url").distinct()
    # pages are known by numbers, so that no round moves their addresses
    named = cut(pages.groupBy("list_id", "url").agg(F.min("next").alias("next")).withColumn("node", F.monotonically_increasing_id()))
    led = named.join(begun.select("list_id", origin("url").alias("origin")).distinct(), "list_id").where((origin("next") == F.col("origin")) & (F.col("origin") != ""))
    led = led.select("list_id", F.col("next").alias("url"), F.col("node").alias("from_id"))
    nexts = led.join(named.select("list_id", "url", F.col("node").alias("to_id")), ["list_id", "url"]).select("from_id", "to_id")
    walked = walk(nexts, begun.join(named, ["list_id", "url"]).select("node"), most_pages)
    return walked.join(named, "node").select("list_id", "url", F.col("pos").alias("place"))


def list_entries(walked: DataFrame, rows: DataFrame, key: str = "title_id") -> DataFrame:
    """The entries of walked pages in order, the first of each title of a list. rows: list_id, url, row, and the entry's columns."""
    from pyspark.sql.window import Window

    read = rows.join(walked, ["list_id", "url"])
    first = read.withColumn("_n", F.row_number().over(Window.partitionBy("list_id", key).orderBy("place", "row"))).where("_n = 1").drop("_n")
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("list_id").orderBy("place", "row")) - 1)


def snapshot_hits(wanted: DataFrame, snapshots: DataFrame, version: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """Stored records that serve (right version, not expired), and the keys to fetch. snapshots: key, version, expires_at, payload."""
    live = snapshots.where((F.col("version") == version) & (F.col("expires_at") > now) & F.col("payload").isNotNull())
    return wanted.join(live, "key"), wanted.join(live.select("key"), "key", "left_anti")


def library_export(entries: DataFrame, exported_at: Column) -> DataFrame:
    """One JSON document a user: version, time, works in order of their ids."""
    work = F.struct("work_id", "status", "rating", "watched")
    works = entries.groupBy("user_id").agg(F.sort_array(F.collect_list(work)).alias("works"))
    return works.select("user_id", F.to_json(F.struct(F.lit(1).alias("version"), exported_at.alias("exportedAt"), "works")).alias("document"))


def schema_text(types: DataFrame) -> DataFrame:
    """Declarations of object types with the interfaces that name them, one a row, in order of names.

    types: name, kind (INTERFACE or OBJECT), possible (names of an interface's objects), fields (struct name, type)."""
    made = types.where("kind = 'INTERFACE'").select(F.explode("possible").alias("name"), F.col("name").alias("interface"))
    of = made.groupBy("name").agg(F.sort_array(F.collect_set("interface")).alias("interfaces"))
    head = F.when(F.col("kind") == "INTERFACE", "interface ").otherwise("type ")
    lines = F.array_join(F.transform("fields", lambda f: F.concat(F.lit("  "), f["name"], F.lit(": "), f["type"])), "\n")
    implements = F.when(F.col("interfaces").isNotNull(), F.concat(F.lit(" implements "), F.array_join("interfaces", " & "))).otherwise("")
    return types.join(of, "name", "left").select("name", F.concat(head, "name", implements, F.lit(" {\n"), lines, F.lit("\n}")).alias("sdl"))
