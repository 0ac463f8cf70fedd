"""Boundary ids: parse under a profile, admit, format, and the keys of the graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The services, those that number episodes without seasons, and what each profile admits besides TMDB.
KEYWORDS = ["anilist", "kitsu", "mal", "tmdb", "tvdb"]
FLAT = ["anilist", "kitsu", "mal"]
ADMITS = {"anime": ["anilist", "imdb", "kitsu", "mal", "tvdb"], "movie": ["imdb"], "series": ["imdb"]}
TMDB_NAMESPACE = {"movie": "movie", "series": "tv"}


def _count(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def admission_error(profile: Column, service: Column) -> Column:
    """Why a service is not admitted under a profile; null where it is."""
    admitted = F.lit(False)
    for name, services in ADMITS.items():
        admitted = admitted | ((profile == name) & service.isin(services))
    return (
        F.when((service == "tmdb") & (profile == "anime"), F.lit("tmdb-not-in-anime"))
        .when(service == "tmdb", F.lit(None).cast("string"))
        .when(~admitted, F.lit("service-not-in-profile"))
    )


def parse(profile: Column, raw: Column) -> Column:
    """struct(reason, service, namespace, id, season, episode); reason is null for a good id, and then the rest stand.

    The first check that fails gives the reason: the service, its native id, its admission, then the locator."""
    parts = F.split(raw, ":")
    head = F.get(parts, F.lit(0))
    glued = head.rlike("^tt[0-9]+$")
    service = F.when(glued, F.lit("imdb")).when(head.isin(KEYWORDS), head)
    native = F.when(glued, head).otherwise(F.get(parts, F.lit(1)))
    rest = F.slice(parts, F.when(glued, 2).otherwise(3), F.greatest(F.size(parts), F.lit(1)))
    n = F.size(rest)
    one, two = _count(F.get(rest, F.lit(0))), _count(F.get(rest, F.lit(1)))
    flat = service.isin(FLAT)
    season = F.when(n == 0, F.lit(None).cast("long")).when(flat & (n == 1), F.lit(1).cast("long")).otherwise(one)
    episode = F.when(n == 0, F.lit(None).cast("long")).when(flat & (n == 1), one).otherwise(two)
    reason = (
        F.when(service.isNull(), F.lit("unrecognised-service"))
        .when(~glued & ~F.coalesce(native.rlike("^[0-9]+$"), F.lit(False)), F.lit("malformed-native-id"))
        .when(admission_error(profile, service).isNotNull(), admission_error(profile, service))
        .when(n == 0, F.lit(None).cast("string"))
        .when(profile == "movie", F.lit("positional-not-allowed"))
        .when(n > 2, F.lit("extra-qualifier-segment"))
        .when(season.isNull() | episode.isNull(), F.lit("malformed-locator"))
        .when(flat & (season != 1), F.lit("season-not-one"))
    )
    namespace = F.when(service == "tmdb", F.when(profile == "movie", "movie").when(profile == "series", "tv"))
    good = lambda c: F.when(reason.isNull(), c)
    return F.struct(
        reason.alias("reason"), good(service).alias("service"), good(namespace).alias("namespace"), good(native).alias("id"), good(season).alias("season"), good(episode).alias("episode")
    )


def format_id(service: Column, native: Column, season: Column, episode: Column) -> Column:
    """struct(id, error): the boundary id; flat catalogues can't show another season than 1."""
    head = F.when(service == "imdb", native).otherwise(F.concat_ws(":", service, native))
    flat = service.isin(FLAT)
    error = F.when(episode.isNotNull() & flat & (season != 1), F.lit("flat-season-not-one"))
    text = F.when(episode.isNull(), head).when(flat, F.concat_ws(":", head, episode.cast("string"))).otherwise(F.concat_ws(":", head, season.cast("string"), episode.cast("string")))
    return F.struct(F.when(error.isNull(), text).alias("id"), error.alias("error"))


def graph_member(service: Column, namespace: Column, native: Column) -> Column:
    """The id under which the graph stores a title: TMDB's with its namespace."""
    return F.when(service == "tmdb", F.concat_ws(":", namespace, native)).otherwise(native)


def graph_locator(season: Column, episode: Column) -> Column:
    return F.when(season.isNotNull() & episode.isNotNull(), F.concat(F.lit("s"), season.cast("string"), F.lit("e"), episode.cast("string")))


def locator_parts(locator: Column) -> Column:
    """struct(season, episode) of s<S>e<E>; nulls for any other locator."""
    form = "^s([0-9]+)e([0-9]+)$"
    return F.struct(F.regexp_extract(locator, form, 1).try_cast("long").alias("season"), F.regexp_extract(locator, form, 2).try_cast("long").alias("episode"))


#: The hosts that catalogues answer on.
OFFICIAL_HOSTS = {
    "anidb": ["anidb.net", "api.anidb.net"],
    "anilist": ["anilist.co", "graphql.anilist.co"],
    "imdb": ["imdb.com", "www.imdb.com"],
    "kitsu": ["kitsu.app", "kitsu.io"],
    "mal": ["myanimelist.net", "api.myanimelist.net"],
    "tmdb": ["themoviedb.org", "www.themoviedb.org", "api.themoviedb.org"],
    "tvdb": ["thetvdb.com", "www.thetvdb.com", "api4.thetvdb.com"],
}


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1))
    return F.when(host != "", host)


def official_host(url: Column, operator: Column) -> Column:
    """Whether a URL's host is exactly one of its operator's, or, without an operator, of any catalogue's."""
    of = F.create_map(*[x for k, hosts in OFFICIAL_HOSTS.items() for x in (F.lit(k), F.array(*map(F.lit, hosts)))])
    every = F.array(*[F.lit(h) for hosts in OFFICIAL_HOSTS.values() for h in hosts])
    allowed = F.when(operator.isNull(), every).otherwise(F.try_element_at(of, F.lower(operator)))
    return F.coalesce(F.array_contains(allowed, host_of(url)), F.lit(False))
