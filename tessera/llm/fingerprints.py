"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is the weighted set of its five-word shingles (words: runs between white space, lower-cased; weight: number of
occurrences; a text of fewer words has one shingle). For each of ``SAMPLES`` hash functions a shingle x of weight w draws
r and c from Gamma(2, 1) and b from [0, 1) by its hash and takes t = floor(ln w / r + b), y = exp(r (t - b)),
a = c / (y e^r); the pair (x, t) of least a is the sample. Two documents agree in a sample with the probability of their
generalised Jaccard similarity. r and c come from tables of ``QUANTILES`` quantiles of the distribution, which spares the
logarithms; all of it is generated code between an explode and a partial aggregate, so only one row per document and
task is shuffled.

Defined cases: a null text is empty; texts without words have the fingerprint of zeros only, and are alike; equal texts
have equal fingerprints; rows of the same doc_id stand in the order of a hash of their text; repeated rows count as one
document for what follows what, and each gets its row; a single document is followed by itself. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialise, text_of

WORDS, SAMPLES, QUANTILES = 5, 64, 4096
RANGES = 64  # stretches of doc_id in which each document's next one is found


def gamma_quantiles(n: int) -> np.ndarray:
    """Middles of n equally likely stretches of Gamma(2, 1), whose distribution function is 1 - (1 + x) e^-x."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


def _table(df: DataFrame, values: np.ndarray) -> Column:
    """The values as a one-row subquery, which is evaluated once and not written out in plans."""
    text = ",".join(f"{v:.12g}" for v in values)
    return df.sparkSession.range(1).select(F.split(F.lit(text), ",").cast("array<double>")).scalar()


def shingle_hashes(text: Column) -> Column:
    """Sorted hashes of all five-word shingles."""
    hashes = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        five = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]))
        return F.when(F.size(h) >= WORDS, five).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    # transform over one element binds the word hashes to a name, so that they are computed once
    return F.sort_array(F.flatten(F.transform(F.array(hashes), grams)))


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fingerprint (SAMPLES times four hex digits) for rows of keys and text; equal keys must mean equal texts."""
    quantiles = gamma_quantiles(QUANTILES)
    r_table, c_table = _table(rows, quantiles), _table(rows, np.log(quantiles))
    own = rows.select(*keys, shingle_hashes(F.col("text")).alias("_s"))
    own = own.withColumn("_starts", F.filter(F.sequence(F.lit(0), F.greatest(F.size("_s") - 1, F.lit(0))), lambda i: (F.size("_s") > 0) & ((i == 0) | (F.get("_s", i - 1) != F.get("_s", i)))))
    own = own.withColumn("_r", r_table).withColumn("_c", c_table)
    each = own.withColumn("_k", F.explode_outer(F.when(F.size("_starts") > 0, F.sequence(F.lit(0), F.size("_starts") - 1))))
    at = F.get("_starts", F.col("_k"))
    each = each.select(*keys, "_r", "_c", F.get("_s", at).alias("_x"), F.log(F.coalesce(F.get("_starts", F.col("_k") + 1), F.size("_s")) - at).alias("_w"))
    bits = int(math.log2(QUANTILES))
    samples = []
    for k in range(SAMPLES):
        h = F.xxhash64("_x", F.lit(k))
        r = F.get("_r", h.bitwiseAND(QUANTILES - 1).cast("int"))
        log_c = F.get("_c", F.shiftright(h, bits).bitwiseAND(QUANTILES - 1).cast("int"))
        b = F.shiftrightunsigned(h, 2 * bits) * F.lit(2.0 ** -(64 - 2 * bits))
        t = F.floor(F.col("_w") / r + b)
        log_a = log_c - r * (t - b) - r
        # ln a, moved above zero and scaled, in the upper 32 bits; the sample's name in the lower ones
        samples.append(F.min(F.shiftleft(F.floor((log_a + 64) * F.lit(float(1 << 24))), 32).bitwiseOR(F.col("_x").bitwiseXOR(t).bitwiseAND(0xFFFFFFFF))).alias(f"_m{k}"))
    least = each.groupBy(*keys).agg(*samples)
    digits = [F.lpad(F.hex(F.xxhash64(f"_m{k}").bitwiseAND(0xFFFF)), 4, "0") for k in range(SAMPLES)]
    return least.select(*keys, F.when(F.col("_m0").isNull(), F.lit("0" * 4 * SAMPLES)).otherwise(F.lower(F.concat(*digits))).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples in which two fingerprints, in binary, agree."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda k: F.substring(a, k * 2 + 1, 2) == F.substring(b, k * 2 + 1, 2))
    return F.size(same) / F.lit(float(SAMPLES))


def followers(docs: DataFrame) -> DataFrame:
    """k1, k2 (key of a distinct row), doc_id, n, copies, and the key of the row that follows by doc_id (cyclic)."""
    rows = docs.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count("*").alias("copies"))
    order = ["doc_id", "k1", "k2"]
    # doc_id is cut into stretches; each stretch is ordered for itself, and the last of one is followed by the first of the next
    ranged = materialise(rows.repartitionByRange(RANGES, *order).withColumn("part", F.spark_partition_id()), "stretches")
    key = F.struct(F.lit(0).alias("any"), "k1", "k2")
    firsts = ranged.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "k1", "k2")).alias("f"))
    heads = firsts.select("part", "f.k1", "f.k2")
    w = Window.orderBy("part")  # a row per stretch
    wrapped = F.first(F.struct("k1", "k2")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("part", F.coalesce(F.lead(F.struct("k1", "k2")).over(w), wrapped).alias("_after"))
    inside = ranged.withColumn("_next", F.lead(key).over(Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "k1", "k2")))
    return inside.join(F.broadcast(after), "part").select(
        "k1", "k2", "doc_id", "n", "copies", F.coalesce("_next.k1", "_after.k1").alias("next1"), F.coalesce("_next.k2", "_after.k2").alias("next2")
    )


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs."""
    keyed = docs.select("doc_id", text_of().alias("text")).withColumns(
        {"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id", F.lit(11))}
    )
    order = materialise(followers(keyed.select("doc_id", "k1", "k2", F.length("text").cast("long").alias("n"))), "followers")
    # what a text needs to be edited: the first characters of the next one, which are looked up by the next one's key
    before = order.select(F.col("next1").alias("k1"), F.col("next2").alias("k2"), F.col("k1").alias("prev1"), F.col("k2").alias("prev2"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    heads = keyed.select("k1", "k2", "text").join(before, ["k1", "k2"]).select(F.col("prev1").alias("k1"), F.col("prev2").alias("k2"), F.expr("left(text, need)").alias("_head"))
    heads = heads.dropDuplicates(["k1", "k2"])  # one copy of a repeated row speaks for all
    # the whole text is moved by its key once, for what it gives to the text before it and for what it keeps itself (cut after that
    # move, or it would be another one); the samples of an edited text are found where the join has put it
    edited = keyed.select("k1", "k2", "text").join(heads.hint("merge"), ["k1", "k2"])
    edited = edited.select("k1", "k2", F.concat(F.expr("left(text, length(text) - CAST(floor(length(text) / 2) AS INT))"), "_head").alias("text"))
    edited = edited.select("k1", "k2", F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    # in binary, at half the bytes, until the last projection
    binary = F.unhex("fingerprint").alias("fingerprint")
    own = materialise(fingerprint(keyed.select("k1", "k2", "text"), ["k1", "k2"]).select("k1", "k2", binary), "fingerprints")
    changed = fingerprint(edited, ["k1", "k2", "sha"]).select("k1", "k2", "sha", F.unhex("fingerprint").alias("_edited"))
    changed = materialise(changed, "edited")
    following = own.select(F.col("k1").alias("next1"), F.col("k2").alias("next2"), F.col("fingerprint").alias("_following"))
    return (
        order.join(own, ["k1", "k2"])
        .join(changed, ["k1", "k2"])
        .join(following, ["next1", "next2"])
        .withColumns({"near_edited": likeness(F.col("fingerprint"), F.col("_edited")), "near_next": likeness(F.col("fingerprint"), F.col("_following"))})
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            "doc_id",
            F.col("n").alias("n_chars"),
            F.lower(F.hex("sha")).alias("edited_sha256"),
            F.lower(F.hex("fingerprint")).alias("fingerprint"),
            F.lower(F.hex("_edited")).alias("edited_fingerprint"),
            "near_edited",
            "near_next",
        )
    )
