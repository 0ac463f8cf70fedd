"""N-gram Jaccard join with Bayesian candidate pruning.

Words are the runs between white space of the lower-cased text; a document is the set of its five-word shingles. Texts of
the same words form one node (copies are never expanded). Per node a signature of ``BANDS * ROWS`` MinHash values (a byte
each) is taken; nodes that agree in all rows of a band are candidates. A candidate pair's values are compared
``STEP`` at a time, and the pair is dropped as soon as the posterior probability (uniform prior) that its similarity
reaches the threshold is below ``TOLERANCE``. What survives spans components; inside each every pair is verified exactly
from the shingle sets, so the numbers of links are exact. A pair of similarity 0.8 shares no band with probability
2e-5, of 0.9 with 3e-12.

Buckets and components of n nodes are cut into chunks of 8 sqrt(n) nodes, at most ``CHUNK``, and pairs of chunks are dealt
to tasks, so a node moves sqrt(n) / 8 times; pairs of nodes exist in numpy blocks only and are never emitted as rows.

Defined cases: a null text is empty; texts without words form one node of copies; a text of fewer than five words has the
one shingle of all its words and so links with copies only; repeated rows each get their row. The identity of a text is
the 128-bit digest of its words, never its doc_id: texts of null or equal doc_ids are linked as any others, and a class without a doc_id
has a null class_id. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_groups, materialise, nested, small_side, text_of
from tessera.llm.groups import components, local_roots, starts_of, whole_groups

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 36, 6
STEP, TOLERANCE = 24, 1e-6
CHUNK, SPREAD, PAIRS = 2048, 64, 100_000
HASHES = BANDS * ROWS

_rng = np.random.Generator(np.random.PCG64(20_240_229))
_XOR = _rng.integers(0, 2**32, HASHES, np.uint32)
_ODD = _rng.integers(0, 2**32, HASHES, np.uint32) | np.uint32(1)
_MIX = _rng.integers(0, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    MOST = 250_000

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < self.MOST:
            self[word] = h
        return h


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(words: list[str], hashes: WordHashes) -> np.ndarray:
    """64-bit hashes of the five-word shingles, with repetitions; empty for fewer words."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.zeros(n, np.uint64)
    for j in range(WORDS):
        s += w[j : j + n] * _MIX[j]
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return s ^ (s >> np.uint64(32))


def signature(s: np.ndarray) -> bytes:
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    short = s.astype(np.uint32)
    for i in range(0, len(short), 1024):
        low = np.minimum(low, ((short[i : i + 1024, None] ^ _XOR) * _ODD).min(0))
    return (low & np.uint32(255)).astype(np.uint8).tobytes()


def least_matches(threshold: float = SIMILARITY) -> np.ndarray:
    """For each number of steps: the fewest agreeing values with which a pair goes on.

    Two bytes agree with probability p = s + (1 - s) / 256 at similarity s; with a uniform prior on s the posterior
    of s >= threshold is a ratio of integrals of p^m (1-p)^(n-m), taken on a grid.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            mass = np.exp(logs - logs.max())
            if mass[s >= threshold].sum() >= TOLERANCE * mass.sum():
                out.append(m)
                break
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, sig: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows a and b of sig) that no step of the comparison drops."""
    match = np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        if not len(a):
            break
        at = slice(k * STEP, (k + 1) * STEP)
        match += (sig[a, at] == sig[b, at]).sum(1)
        on = match >= need
        a, b, match = a[on], b[on], match[on]
    return a, b


def pairs_within(starts: np.ndarray, total: int, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each group in portions of about PAIRS. side: 0 where a group is one chunk; else 1 and 2, paired across."""
    ends = np.append(starts[1:], total)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for s, e in zip(starts, ends, strict=True):
        across = bool(side[s:e].any())
        one, two = (s + np.flatnonzero(side[s:e] == k) for k in (1, 2)) if across else (np.arange(s, e),) * 2
        strip = max(1, PAIRS // max(1, len(two)))
        for at in range(0, len(one), strip):
            some = one[at : at + strip]
            a, b = np.repeat(some, len(two)), np.tile(two, len(some))
            if not across:
                a, b = a[a < b], b[a < b]
            held.append((a, b))
            size += len(a)
            if size > PAIRS:
                yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                held, size = [], 0
    if size:
        yield np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        nodes, sigs = [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            nodes.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            s = shingles(words, hashes)
            sigs.append(signature(s) if len(s) else None)
        # doc_id stays an Arrow column: a null beside it changes no id
        kept = [batch.column("doc_id"), batch.column("text_hash")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "node", "sig"])


def _dealt(rows: DataFrame, key: str, node: str) -> DataFrame:
    """rows with a count column n of their key's nodes: each node once for every pair of chunks that it is in."""
    m = F.greatest(F.ceil(F.sqrt(F.col("n") / F.lit(SPREAD))), F.ceil(F.col("n") / F.lit(CHUNK))).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(7)), m).cast("int")
    return (
        rows.withColumn("_m", m)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
        .withColumn("_lo", F.least("_own", "_other"))
        .withColumn("_hi", F.greatest("_own", "_other"))
        .withColumn("side", F.when(F.col("_lo") == F.col("_hi"), 0).when(F.col("_own") == F.col("_lo"), 1).otherwise(2))
        .drop("_m", "_own", "_other", "n")
        .repartition(key, "_lo", "_hi")
        .sortWithinPartitions(key, "_lo", "_hi", node)
    )


def _span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Star links among the survivors of each bucket."""
    least = least_matches()
    for pdf in whole_groups(batches, ["bucket", "_lo", "_hi"]):
        node = pdf["node"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), HASHES)
        a, b = [], []
        for x, y in pairs_within(starts_of(pdf, ["bucket", "_lo", "_hi"]), len(pdf), pdf["side"].to_numpy()):
            x, y = survivors(x, y, sig, least)
            a.append(x)
            b.append(y)
        if a:
            root = local_roots(len(pdf), np.concatenate(a), np.concatenate(b))
            at = np.flatnonzero(root != np.arange(len(pdf)))
            yield pd.DataFrame({"a": node[at], "b": node[root[at]]}).drop_duplicates()


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that span what survives the pruning, from nodes (node, sig)."""
    bands = nodes.where("sig IS NOT NULL").select(
        "node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * ROWS + 1, ROWS)))).alias("bucket")
    )
    full = materialise(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = BANDS * nodes.count()
    held = small_side(full)
    met = bands.join(held, "bucket") if held is not full else join_groups(bands, full, ["bucket"], "n", total)
    shared = met.join(nodes.select("node", "sig"), "node")
    return _dealt(shared, "bucket", "node").select("bucket", "_lo", "_hi", "side", "node", "sig").mapInPandas(_span, "a binary, b binary")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "set": [np.unique(shingles(words_of(t), hashes)).tobytes() for t in pdf["text"]]})


def shared_counts(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[one] (rows) with sets[two] (columns)."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kinds, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    more = times > 1
    rank = np.cumsum(more) - 1
    use = more[column]
    column, owner = rank[column[use]], owner[use]
    total, out = int(more.sum()), np.zeros((len(one), len(two)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 2048
    for start in range(0, total, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - start] = 1
        out += m[one] @ m[two].T
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per node: links found in its pairs of chunks, documents behind them, and the smallest linked node of each part."""
    keys = ["component", "_lo", "_hi"]
    for pdf in whole_groups(batches, keys, 256):
        starts = starts_of(pdf, keys)
        for s, e in zip(starts, np.append(starts[1:], len(pdf)), strict=True):
            part = pdf.iloc[s:e]
            node, copies, side = part["node"].to_numpy(), part["copies"].to_numpy(), part["side"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in part["set"]]
            size = np.array([len(x) for x in sets])
            one, two = (np.flatnonzero(side == 1), np.flatnonzero(side == 2)) if side.any() else (np.arange(len(part)),) * 2
            both = shared_counts(sets, one, two)
            linked = both >= SIMILARITY * (size[one][:, None] + size[two][None, :] - both) - 1e-9 if len(both) else both > 0
            if not side.any():
                np.fill_diagonal(linked, False)
            a, b = np.nonzero(linked)
            a, b = one[a], two[b]
            n = np.bincount(a, minlength=len(part)) + (np.bincount(b, minlength=len(part)) if side.any() else 0)
            docs = np.bincount(a, copies[b], len(part)) + (np.bincount(b, copies[a], len(part)) if side.any() else 0)
            root = local_roots(len(part), a, b)
            yield pd.DataFrame({"node": node, "links": n, "linked_docs": docs.astype(np.int64), "root": node[root]})


def _placed(docs: DataFrame) -> DataFrame:
    """The rows of join with text_hash, and root: the id of the class."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    members = materialise(text.mapInArrow(sign, "doc_id long, text_hash long, node binary, sig binary"), "signatures")
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")  # the row that stands for a node
    nodes = materialise(members.groupBy("node").agg(F.min(one).alias("one"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "nodes")
    found = components(candidates(nodes))
    sizes = materialise(found.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    inside = found.join(sizes, "root").withColumnRenamed("root", "component").join(nodes.drop("sig"), "node")
    inside = materialise(inside, "inside")
    # while it can be broadcast, only the texts of candidates move, and not all texts
    wanted = small_side(inside.select("node", F.col("one.doc_id").alias("_id"), F.col("one.text_hash").alias("_hash")))
    sets = (
        text.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("node", "text")
        .mapInPandas(_sets, "node binary, set binary")
        .dropDuplicates(["node"])  # of repeated rows
    )
    dealt = _dealt(inside.join(sets, "node"), "component", "node").select("component", "_lo", "_hi", "side", "node", "copies", "set")
    parts = materialise(dealt.mapInPandas(_verify, "node binary, links long, linked_docs long, root binary"), "links")
    counts = parts.groupBy("node").agg(F.sum("links").alias("links"), F.sum("linked_docs").alias("linked_docs"), F.min("root").alias("low"))
    # A component of one chunk is settled in its task; those of more are joined from their parts.
    torn = inside.where(F.col("n") > F.least(F.lit(CHUNK), F.lit(SPREAD))).select("node")
    joined = components(parts.join(torn, "node", "left_semi").select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = counts.join(joined, "node", "left").select("node", "links", "linked_docs", F.coalesce("root", "low").alias("root"))
    classes = materialise(classes.join(inside.select("node", "one"), "node"), "classes")
    least = classes.groupBy("root").agg(F.min("one.doc_id").alias("class_id"))
    of = nodes.drop("sig").join(classes.drop("one").join(least, "root"), "node", "left")
    of = materialise(of, "placed")
    total = of.agg(F.sum("copies")).first()[0] or 0
    return join_groups(members.select("doc_id", "text_hash", "node"), of, ["node"], "copies", total).select(
        "doc_id",
        F.coalesce("class_id", "one.doc_id").alias("class_id"),
        F.col("one.doc_id").alias("copy_of"),
        F.col("copies").alias("n_copies"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("linked_docs", F.lit(0)).cast("long").alias("n_linked_docs"),
        "text_hash",
        F.coalesce("root", "node").alias("root"),
    )


def join(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest doc_id that links lead to), copy_of (smallest doc_id of the same
    words), n_copies, n_links (other texts of similarity 0.8 or more), n_linked_docs (documents of those texts)."""
    return _placed(docs).drop("text_hash", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, one of each class: that with the smallest doc_id, or one of those without.

    Rows of one doc_id and text are told apart by nothing that is read: any one of them stays."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    rows = _placed(docs).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    least = rows.groupBy("root").agg(F.min(F.struct(key.alias("key"), "n")).alias("least"))
    first = materialise(least.select("least.key.doc_id", "least.key.text_hash", "least.n"), "kept")
    own = nested(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(text_of()))
    found = own.join(first, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select("row", "id", "hash", "n")
    return found.where("n = 1").unionByName(found.where("n > 1").dropDuplicates(["id", "hash"])).select("row.*")
