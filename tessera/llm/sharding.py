"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered over the whole table in the order of (doc_id, size, text_crc32), null ids first. A Feistel network
permutes the numbers below the next power of four, and walks along a cycle of it until a number below the number of rows
comes, so it permutes the row numbers themselves. Position p of the shuffle is slot p // shards of shard p % shards: shard sizes
differ by one at most, slots have no gaps, and both can be computed from a row number alone, as can the row number from them.
The shuffle depends on nothing but the keys of the rows and the seed: neither files, partitions nor the cluster count.

Only the keys are sorted, never texts: equal keys are counted first, ranges of keys are counted on in their tasks, and the
driver adds up one number for each range. Of a key that is held by very many rows only its count is sorted; its rows are written
out by many tasks.

Defined cases: a null text has no bytes, so size 8 and checksum 0; rows of equal keys are numbered each, and which is
which cannot be told from what is returned; null ids come first; an empty table yields no rows; other columns are kept by
``assign`` whatever their names are, and not read by ``places``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, nested, text_of

SHARDS, SEED, ROUNDS, LAW = 24, 20, 6, "rows"
PRIME = (1 << 31) - 1
#: Rows of one key that one task writes out; those of a key with more are dealt to several tasks.
CHUNK = 100_000
KEYS = ["doc_id", "size", "text_crc32"]


class Permutation:
    """A permutation of 0..n-1 (n up to 2^62), given by a seed."""

    def __init__(self, n: int, seed: int = SEED):
        self.n, self.width = n, max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.width) - 1
        self.keys = []
        for k in range(ROUNDS):
            h = hashlib.sha256(f"{seed}/{k}".encode()).digest()
            self.keys.append(tuple(int.from_bytes(h[4 * i : 4 * i + 4], "little") % (PRIME - 1) + 1 for i in range(3)))

    def mixed(self, x: np.ndarray, k: int) -> np.ndarray:
        """The round function; every product stays below 2^62."""
        a, b, c = self.keys[k]
        y = (x % PRIME * a + b) % PRIME
        y = (y * y + c) % PRIME
        return (y * y + x) % PRIME & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.width, x & self.mask
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ self.mixed(left, k), left) if back else (right, left ^ self.mixed(right, k))
        return left << self.width | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, np.int64), back)
        while len(far := np.flatnonzero(out >= self.n)):
            out[far] = self._once(out[far], back)
        return out

    def positions(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, positions: np.ndarray) -> np.ndarray:
        return self._walk(positions, True)


def place(numbers: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers in a table of n rows."""
    p = Permutation(n, seed).positions(numbers)
    return p % shards, p // shards


def row_number(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row numbers that stand at a shard and slot."""
    return Permutation(n, seed).numbers(np.asarray(slot, np.int64) * shards + shard)


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32 of every row."""
    text = text_of()
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def counted(rows: DataFrame) -> DataFrame:
    """The distinct keys with n (rows of it), range, and inside (rows of the range before it), written in order of keys."""
    groups = rows.groupBy(*KEYS).agg(F.count("*").alias("n"))
    ordered = groups.repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    schema = pa.schema([("inside", pa.int64()), ("range", pa.int32())])

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, number = 0, TaskContext.get().partitionId()
        for batch in batches:
            ends = batch.column("n").to_numpy().cumsum() + before
            inside = ends - batch.column("n").to_numpy()
            before = int(ends[-1]) if len(ends) else before
            more = [pa.array(inside, pa.int64()), pa.array(np.full(batch.num_rows, number), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *schema.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema)
    return materialise(ordered.mapInArrow(count_on, f"{fields}, inside long, range int"), "keys")


def places(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """For rows of (doc_id, size, text_crc32): these, copy (0.. among rows of equal keys), row_no, shard, slot."""
    table = counted(rows)
    # one row for each range, of which there are as many as partitions of a shuffle
    sizes = {r.range: r.n for r in table.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    starts = np.zeros(max(sizes, default=0) + 1, np.int64)
    total = 0
    for k in sorted(sizes):
        starts[k] = total
        total += sizes[k]
    shuffle = Permutation(total, seed)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            for part in slices(n):
                some = batch.slice(part.start, part.stop - part.start)
                count = n[part]
                at = np.repeat(np.arange(len(count)), count)
                copy = np.arange(len(at)) - np.repeat(count.cumsum() - count, count) + some.column("first").to_numpy()[at]
                number = (starts[some.column("range").to_numpy()] + some.column("inside").to_numpy())[at] + copy
                p = shuffle.positions(number)
                own = some.select(KEYS).take(pa.array(at))
                more = [pa.array(x, pa.int64()) for x in (copy, number)] + [pa.array(p % shards, pa.int32()), pa.array(p // shards, pa.int64())]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], [*KEYS, "copy", "row_no", "shard", "slot"])

    usual = table.where(F.col("n") <= CHUNK).withColumn("first", F.lit(0).cast("long"))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("part")
    large = table.where(F.col("n") > CHUNK).select("*", parts).repartition("part", *KEYS)
    first = F.col("part") * CHUNK
    large = large.withColumn("first", first).withColumn("n", F.least(F.lit(CHUNK), F.col("n") - first)).drop("part")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*KEYS).schema)
    return usual.unionByName(large).mapInArrow(put, f"{fields}, copy long, row_no long, shard int, slot long")


def slices(n: np.ndarray) -> Iterator[slice]:
    """Stretches of groups that hold about CHUNK rows."""
    mark = (n.cumsum() - n) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(n)]
    return (slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a)


def report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    return places(keys(docs), shards, seed).select(
        F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row whole, as the struct ``row``, with its row_no, shard and slot.

    Rows find their place by their key and, where rows share a key, by their number among these, which is counted in two
    steps (input partition, row) so that no key is gathered."""
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size", "text_crc32")
    where = places(keys(docs), shards, seed).select(key.alias("key"), "copy", "row_no", "shard", "slot")
    text = text_of(F.col("row.text"))
    own = F.concat_ws("/", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("-")), F.octet_length(text).cast("long") + 8, F.crc32(text.cast("binary")))
    rows = nested(docs).select("row", own.alias("key"))
    shared = materialise(rows.groupBy("key").count().where("count > 1").select("key"), "shared")
    again = materialise(rows.join(shared, "key").withColumn("at", F.monotonically_increasing_id()), "again")
    part = F.shiftright("at", 33).alias("part")
    counts = again.groupBy("key", part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("at")) - 1
    again = again.withColumn("part", part).withColumn("inside", inside).join(counts.select("key", "part", before.alias("before")), ["key", "part"])
    again = again.select("row", "key", (F.col("inside") + F.col("before")).alias("copy"))
    once = rows.join(shared, "key", "left_anti").withColumn("copy", F.lit(0).cast("long"))
    return once.unionByName(again).join(where, ["key", "copy"]).drop("key", "copy")


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Parquet folders shard=0.. whose files hold the documents in order of slots; a large shard is written by several tasks."""
    placed = assign(docs, shards, seed)
    placed = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)


def sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same for DuckDB: checksum, numbers, rounds and walk."""
    rounds = []
    for k, (a, b, c) in enumerate(Permutation(1, seed).keys):
        y = f"((r{k} % {PRIME} * {a} + {b}) % {PRIME})"
        y = f"(({y} * {y} + {c}) % {PRIME})"
        rounds.append(f"s{k + 1} AS (SELECT * EXCLUDE (l{k}, r{k}), r{k} AS l{k + 1}, xor(l{k}, ({y} * {y} + r{k}) % {PRIME} & mask) AS r{k + 1} FROM s{k})")
    chain = ", ".join(rounds)
    return f"""
WITH RECURSIVE bits AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) s(i)),
texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
read AS (
  SELECT doc_id, CAST(octet_length(b) AS BIGINT) + 8 AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS text_crc32
  FROM texts, bits),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no FROM read),
dims AS (
  SELECT n, w, (CAST(1 AS BIGINT) << w) - 1 AS mask
  FROM (SELECT n, greatest(1, CAST(ceil(ceil(log2(n)) / 2) AS INT)) AS w FROM (SELECT greatest(count(*), 1) AS n FROM documents))),
walk(row_no, x, steps) AS (
  SELECT row_no, CAST(row_no AS BIGINT), 0 FROM numbered
  UNION ALL
  SELECT row_no, (l{ROUNDS} << w) | r{ROUNDS}, steps + 1 FROM (
    WITH s0 AS (SELECT row_no, steps, n, w, mask, x >> w AS l0, x & mask AS r0 FROM walk, dims WHERE steps = 0 OR x >= n),
    {chain}
    SELECT * FROM s{ROUNDS}))
SELECT doc_id, size, text_crc32, '{LAW}' AS law, CAST(x % {shards} AS INT) AS shard, x // {shards} AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered JOIN walk USING (row_no), dims WHERE steps > 0 AND x < n
"""
