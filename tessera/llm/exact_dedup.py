"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so (after the first line end or full stop once ``MIN_CHUNK`` characters have been
read, after ``MAX_CHUNK`` at the latest), so equal texts have equal chunks. Chunks move as digests, never as text: a
chunk's identifier is a 64-bit number, verified against the chunk's SHA-256 (identifiers that two different chunks share
get a suffix). Documents are then compared by their ordered lists of verified identifiers, their recipes.

Defined cases: a null text is empty; an empty text has the empty recipe, and all such rows form one group; repeated rows
(same doc_id and text) are separate members of a group, and of several rows with the largest doc_id one is kept; a group of null
ids only keeps one of its rows, any other group none of its rows of null id; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_groups, materialise, nested, text_of

MIN_CHUNK, MAX_CHUNK = 512, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lazy up to the first cut point after MIN_CHUNK characters, or MAX_CHUNK characters, or the rest.
CHUNKS = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[\n.]|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, sha (of the normalised text), recipe (verified chunk identifiers, in order), copies (equal rows)."""
    rows = docs.select("doc_id", normalised(text_of()).alias("_t")).select(
        "doc_id",
        F.unhex(F.sha2("_t", 256)).alias("sha"),
        F.transform(F.regexp_extract_all("_t", F.lit(CHUNKS), F.lit(0)), lambda c: F.unhex(F.sha2(c, 256))).alias("_chunks"),
    )
    chunks = rows.select("doc_id", "sha", F.posexplode_outer("_chunks").alias("_i", "_chunk")).withColumn("_id", F.xxhash64("_chunk"))
    digests = chunks.where("_chunk IS NOT NULL").groupBy("_id").agg(F.min("_chunk").alias("_low"), F.max("_chunk").alias("_high"))
    clashes = materialise(digests.where("_low <> _high").select("_id", F.lit(True).alias("_clash")), "clashes")
    name = F.when(F.col("_clash"), F.concat_ws("#", F.hex("_id"), F.hex("_chunk"))).otherwise(F.hex("_id"))
    lists = (
        chunks.join(clashes, "_id", "left")
        .groupBy("doc_id", "sha")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("_chunk").isNotNull(), F.struct("_i", name.alias("_name"))))).alias("_l"),
            F.count_if(F.coalesce(F.col("_i"), F.lit(0)) == 0).alias("copies"),
        )
    )
    return lists.select("doc_id", "sha", F.transform("_l", lambda x: x["_name"]).alias("recipe"), "copies")


def members(docs: DataFrame) -> DataFrame:
    """doc_id, sha, copies (equal rows), keep_id, group_size: a row for each doc_id and normalised text."""
    own = recipes(docs).withColumn("_recipe", F.unhex(F.sha2(F.concat_ws(",", "recipe"), 256))).drop("recipe")
    own = materialise(own, "recipes")
    groups = materialise(own.groupBy("_recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    return join_groups(own, groups, ["_recipe"], "group_size", total).drop("_recipe")


def annotate(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; of equal texts the largest doc_id is kept."""
    return members(docs).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns: of each group of equal texts one row, that with the largest doc_id.

    Rows of one doc_id whose texts are equal are told apart by nothing that is read: any one of them stays."""
    first = members(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "sha", "copies")
    first = materialise(first, "kept")
    rows = nested(docs, id=F.col("doc_id"), hash=F.unhex(F.sha2(normalised(text_of()), 256)))
    found = rows.join(first, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("sha"))).select("row", "id", "hash", "copies")
    return found.where("copies = 1").unionByName(found.where("copies > 1").dropDuplicates(["id", "hash"])).select("row.*")
