"""Queries and SQL of problems 2 and 3: runs and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.incremental import replay
from tessera.operators.snapshots import snapshot_changes
from tessera.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "sync_runs", "run_id", "repo", "branch", "ref", "started_at", "finished_at", "status")
    files = table(spark, folder, "files", "ref", "path", "blob_hash", "loaded_at")
    return replay(runs, files)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at")
    commits = table(spark, folder, "commit_log", "repo", "branch", "ordinal", "sha")
    return snapshot_changes(files, commits)


_RECORD_PATH = r"regexp_replace(replace(path, '\', '/'), '^\./', '')"

P2_SQL = rf"""
WITH good AS (
  SELECT run_id, repo, branch, ref, started_at,
         row_number() OVER (PARTITION BY repo, branch ORDER BY started_at, run_id) AS seq
  FROM (SELECT DISTINCT run_id, repo, branch, ref, started_at FROM sync_runs
        WHERE status = 'ok' AND finished_at IS NOT NULL AND started_at IS NOT NULL)
), seen AS (
  SELECT g.run_id, g.repo, g.branch, g.seq, lower(f.blob_hash) AS blob_hash,
         row_number() OVER (PARTITION BY g.run_id, {_RECORD_PATH}
                            ORDER BY f.loaded_at DESC, lower(f.blob_hash) DESC NULLS LAST) AS rn
  FROM good g JOIN files f ON f.ref = g.ref AND f.loaded_at <= g.started_at
  WHERE f.path IS NOT NULL
), sets AS (SELECT DISTINCT run_id, repo, branch, seq, blob_hash FROM seen WHERE rn = 1 AND blob_hash IS NOT NULL),
marked AS (
  SELECT *, min(seq) OVER (PARTITION BY repo, branch, blob_hash) AS first_seq,
         lag(seq) OVER (PARTITION BY repo, branch, blob_hash ORDER BY seq) AS prev_seq,
         lead(seq) OVER (PARTITION BY repo, branch, blob_hash ORDER BY seq) AS next_seq
  FROM sets
)
SELECT run_id, blob_hash, 'index' AS action FROM marked WHERE seq = first_seq
UNION ALL
SELECT run_id, blob_hash, 'reactivate' FROM marked WHERE seq > first_seq AND prev_seq <> seq - 1
UNION ALL
SELECT g.run_id, m.blob_hash, 'deactivate'
FROM marked m JOIN good g ON g.repo = m.repo AND g.branch = m.branch AND g.seq = m.seq + 1
WHERE m.next_seq IS NULL OR m.next_seq <> m.seq + 1
"""

P3_SQL = rf"""
WITH latest AS (
  SELECT ref, {_RECORD_PATH} AS path, lower(blob_hash) AS blob_hash,
         row_number() OVER (PARTITION BY ref, {_RECORD_PATH}
                            ORDER BY loaded_at DESC NULLS LAST, lower(blob_hash) DESC NULLS LAST) AS rn
  FROM files WHERE ref IS NOT NULL AND path IS NOT NULL
), records AS (SELECT ref, path, blob_hash FROM latest WHERE rn = 1 AND blob_hash IS NOT NULL),
history AS (
  SELECT repo, branch, sha AS ref, row_number() OVER (PARTITION BY repo, branch ORDER BY ordinal, sha) AS seq
  FROM (SELECT DISTINCT repo, branch, ordinal, sha FROM commit_log WHERE sha IN (SELECT ref FROM files))
), pairs AS (
  SELECT n.ref AS new_ref, o.ref AS old_ref FROM history n
  JOIN history o ON o.repo = n.repo AND o.branch = n.branch AND o.seq = n.seq - 1
), new_side AS (SELECT p.new_ref, p.old_ref, r.path, r.blob_hash FROM pairs p JOIN records r ON r.ref = p.new_ref),
old_side AS (SELECT p.new_ref, p.old_ref, r.path, r.blob_hash FROM pairs p JOIN records r ON r.ref = p.old_ref)
SELECT DISTINCT coalesce(n.new_ref, o.new_ref) AS ref, coalesce(n.path, o.path) AS path,
       CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM new_side n FULL OUTER JOIN old_side o ON o.new_ref = n.new_ref AND o.old_ref = n.old_ref AND o.path = n.path
WHERE o.path IS NULL OR n.path IS NULL OR o.blob_hash <> n.blob_hash
"""

QUERIES = {"p2_found": p2_found, "p3_found": p3_found}
SQL = {"p2_found": P2_SQL, "p3_found": P3_SQL}
