"""Title text: normalisation, tokens, similarity; dates, keys and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_title(title: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def alphabetical(title: Column) -> Column:
    """A title as it is sorted: letters of all cases and with all marks are equal."""
    return F.collate(title, "UNICODE_CI_AI")


def tokens(normalised: Column) -> Column:
    """Words of a normalised title; none for an empty one."""
    return F.when(normalised == "", F.array().cast("array<string>")).otherwise(F.split(normalised, " "))


def token_overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of two word sets, 0 if either is empty."""
    either = F.size(F.array_union(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / either)


def normalised_similarity(left: Column, right: Column) -> Column:
    """Half from character edits, half from words, of normalised titles."""
    return words_similarity(left, right, tokens(left), tokens(right))


def words_similarity(left: Column, right: Column, left_words: Column, right_words: Column) -> Column:
    """The same of titles whose words are at hand, so that a title in many pairs is taken apart once."""
    edits = 1 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right))
    return F.when((left == "") | (right == ""), F.lit(0.0)).otherwise(edits * 0.5 + token_overlap(left_words, right_words) * 0.5)


def title_similarity(left: Column, right: Column) -> Column:
    return normalised_similarity(normalise_title(left), normalise_title(right))


def hit_score(similarity: Column, left_year: Column, right_year: Column) -> Column:
    """Score of a search hit: the similarity alone where a year is missing, else with agreement of years within one."""
    agrees = (F.abs(left_year - right_year) <= 1).cast("double")
    return F.when(left_year.isNull() | right_year.isNull(), similarity).otherwise(similarity * 0.6 + agrees * 0.4)


def day_distance(left: Column, right: Column) -> Column:
    """Whole days between two ISO dates; null where either can't be read."""
    return F.abs(F.datediff(left.try_cast("date"), right.try_cast("date")))


def year_of(date: Column) -> Column:
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """ISO date of a year with month and day where known (else the first); null without a year."""
    two = lambda c: F.lpad(F.coalesce(c, F.lit(1)).cast("string"), 2, "0")
    return F.when(year.isNotNull(), F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(day)))


def epoch_day(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def iso_day(date: Column) -> Column:
    """A date as text; years after 9999 without the plus sign that a cast gives them."""
    return F.ltrim(date.cast("string"), F.lit("+"))


def watched_hours(minutes: Column, omitted: Column) -> Column:
    """Hours and minutes as text, with a note where titles were left out."""
    hours, rest = F.floor(minutes / 60), minutes % 60
    text = (
        F.when(minutes <= 0, F.lit("0m"))
        .when(hours == 0, F.concat(rest.cast("string"), F.lit("m")))
        .when(rest == 0, F.concat(hours.cast("string"), F.lit("h")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m")))
    )
    return F.when(omitted, F.concat(text, F.lit(" · some titles omitted"))).otherwise(text)


def year_span(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), last.cast("string")).when(last.isNull() | (first == last), first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))


def percent(part: Column, whole: Column) -> Column:
    """Rounded percentage, 0 of nothing; halves go up."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100.0 / whole + 0.5)).cast("long")


def opaque_ref(prefix: str, number: Column) -> Column:
    """prefix:id in base 36."""
    return F.concat(F.lit(f"{prefix}:"), F.lower(F.conv(number.cast("string"), 10, 36)))


def ref_number(ref: Column) -> Column:
    return F.conv(F.upper(F.regexp_extract(ref, "^[a-z]+:([0-9a-z]+)$", 1)), 36, 10).try_cast("long")


def instance_id(*parts: Column) -> Column:
    """Hexadecimal UTF-8 of the parts with NUL between them."""
    return F.lower(F.hex(F.encode(F.concat_ws("\x00", *parts), "UTF-8")))


def ordered_pair_key(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b).cast("string"), F.lit(":"), F.greatest(a, b).cast("string"))


def continuity_number(key: Column) -> Column:
    """The number of ``continuity:<digits>``; null for any other key."""
    return F.regexp_extract(key, "^continuity:([0-9]+)$", 1).try_cast("long")


def payload_fingerprint(payload: Column) -> Column:
    """Rolling sum of code times place, modulo 4294967291 from 2166136261, as eight hex digits."""
    codes = F.transform(F.filter(F.split(payload, ""), lambda c: c != ""), lambda c, i: F.ascii(c).cast("long") * (i + 1))
    total = F.aggregate(codes, F.lit(2_166_136_261).cast("long"), lambda h, x: (h + x) % 4_294_967_291)
    return F.lpad(F.lower(F.hex(total)), 8, "0")
