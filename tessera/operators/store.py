"""State of an index as versions of tables: every write is a function from the old state to the new one.

First writes win where a key may come again; what replaces, replaces whole
groups.  :class:`TableFolder` keeps versions beside each other and swaps a
manifest, so readers see the old state or the new one, never a mixture.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_wins(old: DataFrame, new: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; of several new rows of a key the first by ``order``."""
    rank = Window.partitionBy(*key).orderBy(*order)
    once = new.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")
    return old.unionByName(once.join(old.select(*key), key, "left_anti").select(*old.columns))


def add_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore by chunk_id."""
    return first_wins(old, new, ["chunk_id"], ["byte_start", "byte_end"])


def add_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore by node_id; the first by path, place and name."""
    return first_wins(old, new, ["node_id"], ["path", "byte_start", "symbol"])


def add_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or ignore by (src, dst, kind)."""
    return first_wins(old, new, ["src", "dst", "kind"], ["src"])


def map_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """The files of every ref in ``new`` (ref, path, blob_hash) replace those of the ref; a path counts once, by the least hash."""
    once = new.groupBy("ref", "path").agg(F.min("blob_hash").alias("blob_hash"))
    return old.join(new.select("ref").distinct(), "ref", "left_anti").select("ref", "path", "blob_hash").unionByName(once)


def put_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, model, dim, vector): new vectors replace old ones of their chunk and model.

    The dim of a model is pinned by its first vectors: a vector of another length
    fails the job, as all later searches would be wrong.
    """
    pinned = old.groupBy("model").agg(F.min("dim").alias("_old")).join(new.groupBy("model").agg(F.min(F.size("vector")).alias("_new")), "model", "full_outer")
    pinned = pinned.select("model", F.coalesce("_old", "_new").alias("_dim"))
    right = F.size("vector") == F.col("_dim")
    checked = new.join(pinned, "model").select(
        "chunk_id", "model", F.col("_dim").alias("dim"), F.when(right, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of another dim than that of model "), "model")).cast("array<float>")).alias("vector")
    )
    return old.join(new.select("chunk_id", "model"), ["chunk_id", "model"], "left_anti").select("chunk_id", "model", "dim", "vector").unionByName(checked.dropDuplicates(["chunk_id", "model"]))


def compatible(rows: DataFrame, tag_col: str, tag: str) -> DataFrame:
    """The rows made under a tag (model and settings, or version of the reader); others count as not there."""
    return rows.where(F.col(tag_col) == tag)


def active_only(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows whose blob is active; of several rows of a blob any active one counts.  Hashes are compared in lower case."""
    live = blobs.where("active and blob_hash is not null").select(F.lower("blob_hash").alias("_live")).distinct()
    return rows.join(live, F.lower("blob_hash") == F.col("_live"), "left_semi")


def missing_vectors(chunks: DataFrame, blobs: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Active chunks without a vector of the model."""
    have = vectors.where((F.col("model") == model) & F.col("vector").isNotNull()).select("chunk_id")
    return active_only(chunks, blobs).join(have, "chunk_id", "left_anti")


def get_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(qid, found, chunk columns): whole chunks by id, active or not; an unknown id has a row of nulls."""
    once = chunks.dropDuplicates(["chunk_id"])
    return ids.select("qid", "chunk_id").join(once.withColumn("found", F.lit(True)), "chunk_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def chunks_of_blobs(chunks: DataFrame, blobs: DataFrame) -> DataFrame:
    """(blob_hash, place, chunk_id, byte_start, byte_end): the chunks of blobs in order."""
    met = chunks.join(blobs.select("blob_hash").distinct(), "blob_hash", "left_semi").select("blob_hash", "chunk_id", "byte_start", "byte_end").distinct()
    order = Window.partitionBy("blob_hash").orderBy("byte_start", "byte_end", "chunk_id")
    return met.withColumn("place", F.row_number().over(order))


class TableFolder:
    """Named tables and metadata of an index in a folder that all executors share.

    A write makes a new folder for each table it changes, then one manifest that
    names the current folders and the metadata; the manifest is created under the
    next number only if that is free, so of two writers one fails.  Old folders
    stay until :meth:`vacuum`.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        fs, Path = self._fs()
        if not fs.exists(Path(self.folder)):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(Path(self.folder)))
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())

    def state(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "tables": {}, "meta": {}}
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.folder}/manifest-{numbers[-1]:09d}").collect())  # one line
        return json.loads(text)

    def table(self, name: str, schema: str) -> DataFrame:
        at = self.state()["tables"].get(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at}") if at else self.spark.createDataFrame([], schema)

    def meta(self, key: str, default=None):
        return self.state()["meta"].get(key, default)

    def write(self, tables: dict[str, DataFrame] | None = None, meta: dict | None = None) -> int:
        """Replaces tables and metadata together; the number of the new state."""
        state = self.state()
        for name, rows in (tables or {}).items():
            at = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.folder}/{at}")
            state["tables"][name] = at
        state["meta"] |= meta or {}
        state["number"] += 1
        fs, Path = self._fs()
        fs.mkdirs(Path(self.folder))
        try:
            out = fs.create(Path(f"{self.folder}/manifest-{state['number']:09d}"), False)  # fails if it is there
        except Exception as error:
            raise RuntimeError(f"state {state['number']} was written by another writer") from error
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return state["number"]

    def vacuum(self) -> int:
        """Deletes what the newest manifest does not name; how many entries went.  No writer may be at work."""
        state, numbers = self.state(), self._numbers()
        fs, Path = self._fs()
        keep, gone = {*state["tables"].values(), f"manifest-{state['number']:09d}"}, 0
        for s in fs.listStatus(Path(self.folder)) if numbers else []:
            if s.getPath().getName() not in keep and not s.getPath().getName().startswith("."):
                gone += bool(fs.delete(s.getPath(), True))
        return gone
