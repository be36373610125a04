"""A log of committed changes: each batch of a stream is there once and whole, or not at all.

A batch is written to its own folder and becomes visible with its commit file, which names its blocks. A
batch that is run again finds its commit and does nothing; one that was killed between both writes is
overwritten. Batches whose blocks have all been finished by every consumer are taken away, the commit first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import Folder

COLUMNS = ("number", "hash", "parent_hash", "op", "seq")


class ChangeLog:
    """Notifications (number, hash, parent_hash, op: commit or revert, seq) below a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Folder(spark, path)

    # writing -------------------------------------------------------------------------------------

    def append(self, batch: DataFrame, batch_id: int) -> bool:
        """The rows of a batch, once; False if the batch is there already (or has been taken away)."""
        if self.files.exists(f"commits/{batch_id}.json") or batch_id <= self.truncated_to():
            return False
        self._write(batch, batch_id)
        self._commit(batch_id)
        return True

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        batch.select(*COLUMNS).repartitionByRange("number").sortWithinPartitions("number", "seq").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batches/{batch_id}")

    def _commit(self, batch_id: int) -> None:
        rows = self._rows(batch_id).agg(F.count(F.lit(1)).alias("rows"), F.min("number").alias("first"), F.max("number").alias("last")).first()
        self.files.replace(f"commits/{batch_id}.json", rows.asDict())

    def sink(self, stream: DataFrame, name: str = "feed"):
        """A streaming query that logs all that the stream holds now; its checkpoint lies beside the log."""
        query = stream.writeStream.foreachBatch(self._once).option("checkpointLocation", f"{self.path}/checkpoints/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def _once(self, batch: DataFrame, batch_id: int) -> None:
        self.append(batch, batch_id)

    # reading -------------------------------------------------------------------------------------

    def commits(self) -> dict[int, dict]:
        """Batch id -> rows, first, last of what is committed."""
        return {int(n.split(".")[0]): self.files.read(f"commits/{n}") for n in self.files.names("commits") if n.endswith(".json") and n[0].isdigit()}

    def _rows(self, *ids: int) -> DataFrame:
        schema = "number long, hash string, parent_hash string, op string, seq long"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/batches/{k}" for k in ids]) if ids else self.spark.createDataFrame([], schema)

    def read(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """The committed notifications of a range of blocks; batches without any of it are not opened."""
        ids = [k for k, c in self.commits().items() if c["rows"] and (last is None or c["first"] <= last) and (first is None or c["last"] >= first)]
        rows = self._rows(*ids)
        rows = rows if first is None else rows.where(F.col("number") >= first)
        return rows if last is None else rows.where(F.col("number") <= last)

    def block(self, hash_: str) -> dict | None:
        """number, hash, parent_hash of a block that the log has committed at some time; None if it hasn't."""
        row = self.read().where((F.col("hash") == hash_) & (F.col("op") == "commit")).select("number", "hash", "parent_hash").first()
        return row and row.asDict()

    def standing(self) -> DataFrame:
        """number, hash of the blocks that stand after all notifications: the last word on each is a commit."""
        last = self.read().groupBy("number", "hash").agg(F.max_by("op", "seq").alias("op"))
        return last.where("op = 'commit'").select("number", "hash")

    # truncation ----------------------------------------------------------------------------------

    def truncated_to(self) -> int:
        return (self.files.read("truncated.json") or {"batch": -1})["batch"]

    def truncate(self, finished: int) -> list[int]:
        """Takes away the oldest batches as long as all their blocks are at or below the finished height."""
        gone, commits = [], self.commits()
        for k in sorted(commits):
            if commits[k]["rows"] and commits[k]["last"] > finished:
                break
            gone.append(k)
        if gone:
            self.files.replace("truncated.json", {"batch": gone[-1], "finished": finished})  # a batch that is gone doesn't come again
        for k in gone:
            self.files.delete(f"commits/{k}.json")
        for k in gone:
            self.files.delete(f"batches/{k}")
        return gone
