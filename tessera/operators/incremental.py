"""Processing only records that are new or changed since the last successful run.

Every run rereads its source from the oldest transaction that was still open at
the last successful run, drops the (key, version) pairs that the processed ledger
holds by an anti-join, and commits ledger and watermark together, so that a crash
neither skips nor repeats a record.  :class:`Ledger` is the running form;
:func:`replay` derives what every run of a whole history did, all runs at once,
by the same watermark and the same pairs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.paths import normal_path
from tessera.operators.snapshots import _NONE, beside
from tessera.session import cut_lineage


def succeeded_runs(runs: DataFrame) -> DataFrame:
    """(run_id, repo, branch, ref, started_at, seq) of the runs with status ok and an end.

    ``seq`` counts the successful runs of a (repo, branch) by started_at.
    Copies of a row count once; runs without a start can't be placed and are left out.
    """
    done = (
        runs.where("status = 'ok' and finished_at is not null and started_at is not null")
        .select("run_id", "repo", "branch", "ref", "started_at")
        .distinct()
    )
    order = Window.partitionBy("repo", "branch").orderBy("started_at", "run_id")
    return done.withColumn("seq", F.row_number().over(order))


def reread_ranges(runs: DataFrame, good: DataFrame) -> DataFrame:
    """(repo, branch, ref, index_id, starts): for every index (repo, branch) and ref its runs that succeeded, by start.

    ``starts`` are (seq, low, started_at): the run rereads the rows of the ref
    loaded from ``low`` to its start.  ``low`` is the start of the oldest run of
    the ref that was open when the last successful one began - that one itself,
    or one that has no end or ended later - and null (all rows) where none
    succeeded before.  ``index_id`` is the least run of the pair and names it.
    """
    every = runs.where("started_at is not null and ref is not null").select("repo", "branch", "ref", "started_at", "finished_at").distinct()
    same = ["repo", "branch", "ref"]
    lists = every.groupBy(*same).agg(F.collect_list(F.struct("started_at", "finished_at")).alias("all"))
    before = Window.partitionBy(*same).orderBy("seq")
    done = good.where("ref is not null").withColumn("prev", F.lag("started_at").over(before)).join(lists, same)
    still_open = F.filter("all", lambda r: (r["started_at"] <= F.col("prev")) & (r["finished_at"].isNull() | (r["finished_at"] > F.col("prev"))))
    low = F.when(F.col("prev").isNotNull(), F.least("prev", F.array_min(F.transform(still_open, lambda r: r["started_at"]))))
    return done.groupBy(*same).agg(F.min("run_id").alias("index_id"), F.array_sort(F.collect_list(F.struct("seq", low.alias("low"), "started_at"))).alias("starts"))


def processed(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, branch, index_id, path, loaded_at, blob_hash, at, starts): each pair by the run that processed it.

    A pair is the key (index, ref, path) and the version (loaded_at, blob_hash).
    A run rereads a range of load times, so it meets pairs of earlier runs again;
    the ledger holds a pair from the first run that met it, and the pairs that a
    later run meets again drop out.  Both, entry and anti-join, are one aggregate:
    the least place ``at`` among the runs of the ref.
    """
    rows = files.where("ref is not null and path is not null and loaded_at is not null").select(
        "ref", normal_path(F.col("path")).alias("path"), "loaded_at", F.lower("blob_hash").alias("blob_hash")
    )
    met = F.filter(
        F.transform("starts", lambda r, i: F.struct(i.alias("at"), ((F.col("loaded_at") <= r["started_at"]) & (r["low"].isNull() | (F.col("loaded_at") >= r["low"]))).alias("in"))),
        lambda x: x["in"],
    )
    reread = beside(rows, ranges, ["ref"]).select("repo", "branch", "index_id", "starts", "path", "loaded_at", "blob_hash", F.explode(F.transform(met, lambda x: x["at"])).alias("at"))
    return (
        reread.repartition("index_id", "path")
        .groupBy("index_id", "path", "loaded_at", "blob_hash")
        .agg(F.min("at").alias("at"), F.first("repo").alias("repo"), F.first("branch").alias("branch"), F.first("starts").alias("starts"))
    )


def visible_sets(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, branch, seq, blob_hash): the set each run has, from the pairs processed up to it.

    Of the versions of a path that are processed so far the latest holds, so a
    late, corrected or withdrawn row changes what a later run of the ref sees.
    A version holds from the run that processed it, unless a later version was
    there already, to the run before the one that processed a later version.
    """
    key = ["index_id", "path"]
    later = Window.partitionBy(*key).orderBy("loaded_at", F.asc_nulls_first("blob_hash")).rowsBetween(1, Window.unboundedFollowing)
    upto = F.coalesce(F.min("at").over(later), F.size("starts"))
    held = processed(ranges, files).withColumn("upto", upto).where("blob_hash is not null and at < upto")
    seqs = F.transform(F.slice("starts", F.col("at") + 1, F.col("upto") - F.col("at")), lambda r: r["seq"])
    return held.select("repo", "branch", "blob_hash", F.explode(seqs).alias("seq"))


def replay(runs: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, blob_hash, action) of every successful run.

    ``index`` are the hashes that no earlier run of the (repo, branch) had,
    ``reactivate`` those that one had, but not the preceding one, ``deactivate``
    those that only the preceding one had.  Empty tables give no rows; a run that
    sees nothing deactivates all that its predecessor saw.  Rows without a load
    time are seen by no run.

    Rows are shuffled twice: by (index, path), where pairs and versions are told,
    and by (index, hash), where the runs of a hash are looked at in order.
    """
    good = cut_lineage(succeeded_runs(runs))
    ranges = cut_lineage(reread_ranges(runs, good))
    known = [F.coalesce(c, F.lit(_NONE)).alias(c) for c in ("repo", "branch")]
    sets = visible_sets(ranges, files).select(*known, "blob_hash", "seq").distinct()
    order = Window.partitionBy("repo", "branch", "blob_hash").orderBy("seq")
    steps = sets.select("repo", "branch", "blob_hash", "seq", F.lag("seq").over(order).alias("was"), F.lead("seq").over(order).alias("next"))
    come = F.when(F.col("was").isNull(), "index").when(F.col("was") < F.col("seq") - 1, "reactivate")
    gone = F.when(F.col("next").isNull() | (F.col("next") > F.col("seq") + 1), "deactivate")
    acts = F.array(F.struct("seq", come.alias("action")), F.struct((F.col("seq") + 1).alias("seq"), gone.alias("action")))
    found = steps.select("repo", "branch", "blob_hash", F.explode(F.filter(acts, lambda a: a["action"].isNotNull())).alias("a"))
    found = found.select("repo", "branch", "blob_hash", "a.seq", "a.action")
    # the last run of an index has no successor, so what it has is not gone anywhere
    return beside(found, good.select(*known, "seq", "run_id"), ["repo", "branch", "seq"]).select("run_id", "blob_hash", "action")


class Ledger:
    """Incremental processing over a folder that all executors share; each (key, version) is handed over by one committed run.

    ``folder`` holds one sub-folder a committed run (the pairs it processed, with
    their transaction times) and a manifest naming them, the low watermark and
    the run count.  A run that fails before its manifest is there leaves files
    that no manifest names; the next run deletes them, starts from the old
    watermark and is given the same number, so a sink that writes under the
    number of its run repeats nothing.  Parts of which every pair is older than
    the watermark can't be met again and are left out, the others are merged when
    they are many.  Keys and versions may be null (compared null-safe); rows with
    a null transaction time are always reread, so they are late but never lost,
    and their pairs are kept.
    """

    #: Parts that are read beside each other before they are merged into one.
    MOST_PARTS = 16

    def __init__(self, spark: SparkSession, folder: str, key: list[str], version: str, at: str):
        self.spark, self.folder, self.key, self.version, self.at = spark, folder.rstrip("/"), key, version, at

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self) -> list[str]:
        fs, Path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(Path(self.folder))) if fs.exists(Path(self.folder)) else []

    def state(self) -> dict:
        """The manifest with the highest number; it is created whole under a number that was free."""
        done = [n for n in self._names() if n.startswith("manifest-")]
        if not done:
            return {"run": 0, "low": None, "parts": []}
        text = self.spark.sparkContext._jsc.sc().textFile(f"{self.folder}/{done[-1]}", 1).first()
        return json.loads(text)

    def _late(self, rows: DataFrame, low: str | None) -> DataFrame:
        """Rows at or after the watermark, and those without a time."""
        return rows if low is None else rows.where(F.col(self.at).isNull() | (F.col(self.at) >= F.lit(low).cast("timestamp_ntz")))

    def pending(self, source: DataFrame) -> DataFrame:
        """The rows to process: reread from the low watermark, less the ledger; of several rows of a pair the first by all columns."""
        state = self.state()
        pairs = [*self.key, self.version]
        order = Window.partitionBy(*pairs).orderBy(self.at, F.to_json(F.struct(*source.columns)))
        rows = self._late(source, state["low"]).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
        if not state["parts"]:
            return rows
        done = self._late(self.spark.read.parquet(*[f"{self.folder}/{p['name']}" for p in state["parts"]]), state["low"]).select(*pairs)
        done = done.withColumnsRenamed({c: f"_done_{c}" for c in pairs})
        same = F.lit(True)
        for c in pairs:
            same = same & F.col(c).eqNullSafe(F.col(f"_done_{c}"))
        return rows.join(done, same, "left_anti")

    def run(self, source: DataFrame, process: Callable[[DataFrame, int], None], oldest_open: str | None) -> int:
        """Process the pending rows, then commit.  ``process`` gets them and the number of the run.  ``oldest_open`` is the
        start (ISO text) of the oldest transaction still open now; later runs reread from there.  Returns the run's number."""
        state = self.state()
        n = state["run"] + 1
        self._sweep(state)
        rows = self.pending(source)
        staged = f"{self.folder}/rows-{n:09d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(staged)  # what is processed is what is recorded, even if the source grows meanwhile
        fixed = self.spark.read.schema(rows.schema).parquet(staged)
        process(fixed, n)
        low = max(x for x in (state["low"], oldest_open) if x is not None) if (state["low"] or oldest_open) else None
        parts = [p for p in state["parts"] if low is None or p["last"] is None or p["last"] >= low]
        part = {"name": f"part-{n:09d}-{uuid.uuid4().hex[:8]}"}
        pairs = fixed.select(*self.key, self.version, self.at)
        if len(parts) >= self.MOST_PARTS:
            pairs = pairs.unionByName(self._late(self.spark.read.parquet(*[f"{self.folder}/{p['name']}" for p in parts]), low))
            parts = []
        pairs.write.parquet(f"{self.folder}/{part['name']}")
        last = self.spark.read.schema(pairs.schema).parquet(f"{self.folder}/{part['name']}").agg(F.max(self.at).cast("string").alias("last"), F.count_if(F.col(self.at).isNull()).alias("none")).first()
        part["last"] = None if last["none"] else last["last"] or ""
        self._commit({"run": n, "low": low, "parts": [*parts, part]})
        fs, Path = self._fs()
        fs.delete(Path(staged), True)
        return n

    def _sweep(self, state: dict) -> None:
        """Deletes what failed runs left, and parts that were dropped or merged."""
        fs, Path = self._fs()
        keep = {p["name"] for p in state["parts"]}
        for name in self._names():
            if name.startswith(("rows-", "part-")) and name not in keep:
                fs.delete(Path(f"{self.folder}/{name}"), True)

    def _commit(self, state: dict) -> None:
        fs, Path = self._fs()
        try:
            out = fs.create(Path(f"{self.folder}/manifest-{state['run']:09d}"), False)  # two writers: the second finds the name taken
        except Exception as error:
            raise RuntimeError(f"run {state['run']} was committed by another writer") from error
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
