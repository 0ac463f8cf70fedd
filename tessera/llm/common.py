"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of documents aims at; a block is what one Python task holds at a time.
BLOCK_BYTES = 12_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Groups of over 1 / HOT_SHARE of all rows are hot; there are fewer than HOT_SHARE of them, so they can be broadcast.
HOT_SHARE = 1000


#: Tables of at most so many narrow rows (about 100 bytes each in memory) are broadcast where their size is known; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def small_side(table: DataFrame) -> DataFrame:
    """A materialised table of narrow rows, to be broadcast if its count allows it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only in local mode, where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def nested(docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of docs whole, as one struct ``row``, beside new columns: their names can clash with none of docs'."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows inner-joined to their groups, one row each with its ``size``; ``total`` is the sum of all sizes.

    Hot groups are broadcast, at most HOT_SHARE of them, so that their rows stay where they are; the others are shuffled.
    Both tables should be materialised, since each is read twice.
    """
    hot = F.broadcast(groups.where(F.col(size) * HOT_SHARE > total))
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(groups.where(F.col(size) * HOT_SHARE <= total), on))


def text_of(column: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def block_count(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> int:
    """Number of blocks so that each holds about ``block_bytes`` of text. One pass over the lengths."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(8, math.ceil(total / block_bytes))


def block_of(n: int, *keys: str) -> Column:
    """The block (0 to n-1) of a row, by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
