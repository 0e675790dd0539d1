"""What changed lately: commits with the symbols they added, removed or modified."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.snapshots import snapshot_changes, snapshot_history, snapshot_records
from tessera.session import cut_lineage

MOST_SYMBOLS = 50


def symbol_diffs(files: DataFrame, commits: DataFrame, facts: DataFrame, most: int = MOST_SYMBOLS) -> DataFrame:
    """(ref, path, symbol, kind, change, n): of every snapshot the first ``most`` symbols that differ from the one before.

    Added files have no side before, removed ones none after.  Of several
    definitions of one (symbol, kind) in a file the last by place stands for it.
    Order is by path, symbol and kind; ``n`` counts from 1 in a snapshot.
    """
    history = cut_lineage(snapshot_history(files, commits))
    order = Window.partitionBy("repo", "branch").orderBy("seq")
    before = history.select("ref", F.lag("ref").over(order).alias("old_ref")).where("old_ref is not null")
    records = cut_lineage(snapshot_records(files).select("ref", "path", "blob_hash"))
    touched = snapshot_changes(files, commits).select("ref", "path").join(before, "ref")
    new = touched.join(records, ["ref", "path"]).select("ref", "path", "blob_hash", F.lit(1).alias("side"))
    old = touched.join(records.select(F.col("ref").alias("old_ref"), "path", "blob_hash"), ["old_ref", "path"]).select("ref", "path", "blob_hash", F.lit(0).alias("side"))
    defs = facts.select("blob_hash", F.explode("defs").alias("d")).groupBy("blob_hash", F.col("d.symbol").alias("symbol"), F.col("d.kind").alias("kind")).agg(
        F.max_by("d.digest", F.struct("d.byte_start", "d.byte_end")).alias("digest")
    )
    sides = new.unionByName(old).join(defs, "blob_hash").groupBy("ref", "path", "symbol", "kind").agg(
        F.max(F.when(F.col("side") == 0, F.col("digest"))).alias("was"), F.max(F.when(F.col("side") == 1, F.col("digest"))).alias("now")
    )
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    found = sides.withColumn("change", change).where("change is not null")
    rank = Window.partitionBy("ref").orderBy("path", "symbol", "kind")
    return found.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= most).select("ref", "path", "symbol", "kind", "change", "n")


def recent_commits(commits: DataFrame, since: str, limit: int = 20) -> DataFrame:
    """(repo, branch, sha, committed_at, author, message, rank): the newest commits of each branch, at most ``limit``.

    ``since`` is an ISO time (a bare date is midnight UTC), or the name of a
    commit: then those after it on its branches.  A name that no commit has raises ValueError.
    """
    once = commits.select("repo", "branch", "ordinal", "sha", "committed_at", "author", "message").distinct()
    if re.fullmatch(r"\d{4}-\d\d-\d\d([T ].*)?", since):
        kept = once.where(F.col("committed_at") >= F.lit(since).cast("timestamp_ntz"))
    else:
        start = once.where(F.col("sha").startswith(since)).groupBy("repo", "branch").agg(F.min("ordinal").alias("_from"))
        if start.isEmpty():
            raise ValueError(f"{since}: no such commit")
        kept = once.join(start, ["repo", "branch"]).where("ordinal > _from").drop("_from")
    order = Window.partitionBy("repo", "branch").orderBy(F.desc("committed_at"), F.desc("ordinal"))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        "repo", "branch", F.substring("sha", 1, 12).alias("sha"), "committed_at", "author", "message", "rank"
    )
