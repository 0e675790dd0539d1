"""Incremental sync as a stream: each micro-batch of files brings an index up to date.

The index is a folder of snapshots ``v=N`` (blobs with their state).  A tree
writes a new snapshot beside the old one; the newest complete one (with its
success mark) is the state, so a crash leaves the old state and a repeated batch
writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import ingest

STATE = "blob_hash string, language string, size_bytes long, active boolean"


class IndexFolder:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def newest(self, upto: int | None = None) -> int:
        """The number of the newest complete snapshot, at most ``upto``; -1 without any."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return -1
        done = [
            int(s.getPath().getName()[2:])
            for s in fs.listStatus(root)
            if s.getPath().getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        ]
        return max((v for v in done if upto is None or v <= upto), default=-1)

    def state(self, version: int | None = None) -> DataFrame:
        v = self.newest(version)
        return self.spark.createDataFrame([], STATE) if v < 0 else self.spark.read.schema(STATE).parquet(f"{self.folder}/v={v}")

    def sync(self, files: DataFrame, version: int) -> None:
        """Takes the files (path, blob_hash, size_bytes) of a tree as the whole desired set, as snapshot ``version``.

        Skipped paths are left out.  Content seen before keeps language and size;
        what is no longer there is set inactive, never deleted.
        """
        kept = files.where(~ingest.is_skipped(F.col("path"), F.col("size_bytes")))
        new = kept.select("blob_hash", ingest.language_of(F.col("path")).alias("language"), F.col("size_bytes").cast("long"))
        old = self.state(version - 1).withColumn("active", F.lit(False))  # what is wanted turns active again
        ingest.upsert_blobs(old, new).select("blob_hash", "language", F.col("size_bytes").cast("long"), "active").write.mode("overwrite").parquet(
            f"{self.folder}/v={version}"
        )


def sync_stream(trees: DataFrame, index: IndexFolder, checkpoint: str) -> StreamingQuery:
    """A stream of trees into the index.  Every row names its tree and says how many files the tree has: (tree_id, n_files,
    path, blob_hash, size_bytes).

    A source may cut a tree into several micro-batches: its rows are kept beside the
    index until as many as the tree has are there, and only then it is taken in.
    Trees that are complete are taken in by their id; ids must rise.  A repeated
    batch writes the same rows again, and a tree already taken in is passed over,
    even if the stream's checkpoint is lost.
    """
    parts = f"{index.folder}/waiting"

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{parts}/batch={batch_id}")
        waiting = df.sparkSession.read.parquet(parts).drop("batch").dropDuplicates(["tree_id", "path"])
        done = index.newest()
        whole = waiting.where(F.col("tree_id") > done).groupBy("tree_id").agg(F.count("*").alias("n"), F.max("n_files").alias("n_files")).where("n >= n_files")
        for row in whole.select("tree_id").orderBy("tree_id").collect():  # one row a tree
            index.sync(waiting.where(F.col("tree_id") == row["tree_id"]), row["tree_id"])

    return trees.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
