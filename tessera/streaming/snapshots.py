"""A table that a stream merges into, batch by batch: versions of Parquet, and a commit that says which one counts.

A batch writes a whole new version and then commits it by one rename, so a reader sees the old version or the new one. The
commit also says which batch of which stream was merged last: a batch that is run again after a failure finds itself there
and changes nothing. One stream writes to a table at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import first_of


def merged(current: DataFrame, batch: DataFrame, keys: list[str], at: str, tie: str | None = None) -> DataFrame:
    """Rows of the later time win, of equal times those that were there, of equal new ones the largest ``tie``."""
    both = current.withColumn("_old", F.lit(1)).unionByName(batch.select(*current.columns).withColumn("_old", F.lit(0)))
    return first_of(both, keys, [F.desc_nulls_last(at), F.desc("_old"), *([F.desc_nulls_last(tie)] if tie else [])]).drop("_old")


class Snapshot:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def version(self) -> tuple[int, dict[str, int]]:
        """The last committed version (0: none yet), and the last batch of each stream in it."""
        if not self._fs.exists(self._at("commits")):
            return 0, {}
        last = max((int(x.getPath().getName()) for x in self._fs.listStatus(self._at("commits")) if x.getPath().getName().isdigit()), default=0)
        if not last:
            return 0, {}
        stream = self._fs.open(self._at("commits", str(last)))
        try:
            return last, json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> DataFrame:
        last, _ = self.version()
        if not last:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{last}")

    def merge(self, batch: DataFrame, stream: str, number: int, keys: list[str], at: str, tie: str | None = None) -> bool:
        """Merge one batch of a stream; False where it was merged before."""
        last, seen = self.version()
        if seen.get(stream, -1) >= number:
            return False
        # what a batch that failed has left of this version is written over
        merged(self.read(), batch, keys, at, tie).write.mode("overwrite").parquet(f"{self.path}/data/{last + 1}")
        self._commit(last + 1, seen | {stream: number})
        for old in (f"data/{last - 1}", f"commits/{last - 1}"):  # the one before stays for those who read it
            if last > 1:
                self._fs.delete(self._at(old), True)
        return True

    def _commit(self, version: int, seen: dict[str, int]) -> None:
        draft = self._at("commits", f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(seen).encode()))
        out.close()
        if not self._fs.rename(draft, self._at("commits", str(version))):
            raise RuntimeError(f"version {version} of {self.path} was committed by another")

    def drain(self, stream: DataFrame, name: str, keys: list[str], at: str, tie: str | None = None) -> None:
        """Merge all that is there of a stream; its progress is kept beside the table."""
        query = stream.writeStream.foreachBatch(lambda df, number: self.merge(df, name, number, keys, at, tie))
        query = query.option("checkpointLocation", f"{self.path}/streams/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
