"""Snapshots and sync runs against plain Python models."""

from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tessera.operators import incremental, snapshots

T0 = datetime(2025, 1, 1)
FILES = "repo string, ref string, path string, blob_hash string, loaded_at timestamp_ntz"
COMMITS = "repo string, branch string, ordinal int, sha string"
RUNS = "run_id long, repo string, branch string, ref string, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def history(seed):
    """Random branches, snapshots, corrected, withdrawn, repeated and late rows."""
    r = random.Random(seed)
    files, commits, runs, run_id, sha = [], [], [], 0, 0
    for repo in ("a", "b"):
        for branch in ("main", "dev"):
            tree, when, refs = {}, T0, []
            for ordinal in range(6):
                sha += 1
                ref = f"r{sha}"
                refs.append(ref)
                commits += [(repo, branch, ordinal, ref)] * r.choice([1, 1, 2])
                for _ in range(r.randint(0, 4)):
                    tree[f"d/f{r.randint(0, 9)}.py"] = f"h{r.randint(0, 12)}"
                if tree and r.random() < 0.5:
                    tree.pop(r.choice(list(tree)))
                when += timedelta(hours=5)
                if r.random() < 0.2:
                    continue  # a commit without a snapshot
                for p, h in tree.items():
                    late = timedelta(hours=r.choice([0, 0, 0, 30]))
                    odd = r.choice([p, "./" + p, p.replace("/", "\\")])
                    files += [(repo, ref, odd, r.choice([h, h.upper()]), when + late)] * r.choice([1, 1, 2])
                    if r.random() < 0.2:
                        files.append((repo, ref, p, r.choice([None, "h99"]), when + timedelta(hours=r.choice([1, 40]))))
                for _ in range(r.randint(0, 2)):
                    run_id += 1
                    at = when + timedelta(minutes=30 + run_id)
                    status = r.choice(["ok", "ok", "ok", "failed", "running"])
                    end = None if status == "running" or r.random() < 0.1 else at + timedelta(minutes=1)
                    runs += [(run_id, repo, branch, r.choice(refs), at, end, status)] * r.choice([1, 2])
    return files, commits, runs


def norm(p):
    p = p.replace("\\", "/")
    return p[2:] if p.startswith("./") else p


def tree_of(files, ref, until=None):
    best = {}
    for _, f_ref, path, h, at in files:
        if f_ref == ref and (until is None or at <= until):
            key = (at, h is not None, (h or "").lower())
            best[norm(path)] = max(best.get(norm(path), (datetime.min, False, "")), key)
    return {p: k[2] for p, k in best.items() if k[1]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_snapshot_changes_equal_a_model(spark, seed):
    files, commits, _ = history(seed)
    want, have = set(), {f[1] for f in files}
    for key in {c[:2] for c in commits}:
        refs = [c[3] for c in sorted(set(c for c in commits if c[:2] == key), key=lambda c: c[2]) if c[3] in have]
        for old, new in zip(refs, refs[1:]):
            a, b = tree_of(files, old), tree_of(files, new)
            for p in a.keys() | b.keys():
                if a.get(p) != b.get(p):
                    want.add((new, p, "added" if p not in a else "removed" if p not in b else "modified"))
    got = snapshots.snapshot_changes(spark.createDataFrame(files, FILES), spark.createDataFrame(commits, COMMITS))
    assert {(r.ref, r.path, r.change) for r in got.collect()} == want
    assert got.count() == len(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_a_model(spark, seed):
    files, _, runs = history(seed)
    want = []
    for key in {r[1:3] for r in runs}:
        seen, before = set(), set()
        for run in sorted({r for r in runs if r[1:3] == key and r[6] == "ok" and r[5]}, key=lambda r: r[4]):
            now = set(tree_of(files, run[3], run[4]).values())
            want += [(run[0], h, "index" if h not in seen else "reactivate") for h in now if h not in seen or h not in before]
            want += [(run[0], h, "deactivate") for h in before - now]
            seen, before = seen | now, now
    got = incremental.replay(spark.createDataFrame(runs, RUNS), spark.createDataFrame(files, FILES))
    assert sorted((r.run_id, r.blob_hash, r.action) for r in got.collect()) == sorted(want)


def test_many_ordinals_of_one_bucket(spark):
    """More than 64 paths, so that a snapshot has several words and values sit beyond the first."""
    old = [("a", "r1", f"p{i}", f"h{i}", T0) for i in range(300)]
    new = [("a", "r2", f"p{i}", f"h{i + (i % 7 == 0)}", T0) for i in range(20, 320)]
    commits = spark.createDataFrame([("a", "m", 0, "r1"), ("a", "m", 1, "r2")], COMMITS)
    got = snapshots.snapshot_changes(spark.createDataFrame(old + new, FILES), commits)
    counts = dict(got.groupBy("change").count().collect())
    assert counts == {"added": 20, "removed": 20, "modified": sum(1 for i in range(20, 300) if i % 7 == 0)}


def test_ordinals_persist(spark):
    keys = spark.createDataFrame([("a", f"p{i}") for i in range(50)], "g string, k string")
    first = snapshots.assign_ordinals(keys, "g", "k", container=20)
    more = snapshots.assign_ordinals(keys.unionByName(spark.createDataFrame([("a", "new"), ("b", "p1")], "g string, k string")), "g", "k", first, container=20)
    before, after = {(r.g, r.k): r.ordinal for r in first.collect()}, {(r.g, r.k): r.ordinal for r in more.collect()}
    assert all(after[k] == v for k, v in before.items()) and len(after) == 52
    assert len({(k[0], v) for k, v in after.items()}) == 52


def test_words_fill_up(spark):
    """A repository of 2,000 paths has at least 16 files in a word, and a container is no limit."""
    keys = spark.createDataFrame([("a", f"src/p{i}.py") for i in range(2000)], "repo string, path string")
    for container in (snapshots.CONTAINER, 500):
        placed = snapshots.assign_ordinals(keys, "repo", "path", container=container).withColumn("blob_hash", F.col("path")).withColumn("seq", F.lit(1))
        blocks = snapshots.ordinal_blocks(placed, ["repo"], ["seq"])
        assert 2000 / blocks.count() >= 16
        assert blocks.agg(F.sum(F.bit_count("bits"))).first()[0] == 2000


def test_a_history_too_long_for_a_broadcast(spark, monkeypatch):
    files, commits, runs = history(2)
    f, c, r = spark.createDataFrame(files, FILES), spark.createDataFrame(commits, COMMITS), spark.createDataFrame(runs, RUNS)
    want = rows(snapshots.snapshot_changes(f, c)), rows(incremental.replay(r, f))
    monkeypatch.setattr(snapshots.beside, "__defaults__", (0,))
    assert (rows(snapshots.snapshot_changes(f, c)), rows(incremental.replay(r, f))) == want


def test_nulls_and_empty_tables(spark):
    none = [(None, None, None, None, None), ("a", "r1", None, "h", T0), ("a", None, "p", "h", T0), (None, "r1", "p", "H", None)]
    commits = spark.createDataFrame([("a", "m", 0, "r1"), (None, None, None, None)], COMMITS)
    files = spark.createDataFrame(none, FILES)
    assert rows(snapshots.snapshot_records(files)) == [("h", "p", "r1", "")]
    assert snapshots.snapshot_changes(files, commits).count() == 0
    assert snapshots.snapshot_changes(files.limit(0), commits.limit(0)).count() == 0
    runs = spark.createDataFrame([(1, "a", "m", "r1", T0, T0, "ok"), (2, None, None, None, None, None, None)], RUNS)
    assert incremental.replay(runs, files).count() == 0  # the only row of the ref has no load time, so no run sees it
    assert incremental.replay(runs.limit(0), files.limit(0)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    files, commits, runs = history(1)
    f = spark.createDataFrame(files, FILES).withColumn("block", F.lit("x")).withColumn("seq", F.lit(1)).withColumn("version", F.lit(2))
    c = spark.createDataFrame(commits, COMMITS).withColumn("seq", F.lit(9)).withColumn("path", F.lit("z"))
    plain = snapshots.snapshot_changes(f.drop("block", "seq", "version"), c.drop("seq", "path"))
    assert rows(snapshots.snapshot_changes(f, c)) == rows(plain)
    r = spark.createDataFrame(runs, RUNS).withColumn("seq", F.lit(3)).withColumn("blob_hash", F.lit("q"))
    assert rows(incremental.replay(r, f)) == rows(incremental.replay(r.drop("seq", "blob_hash"), f.drop("block", "seq", "version")))


def test_ledger_survives_failures(spark, tmp_path):
    """Late rows, a crash in the middle and reruns: every version once, none lost."""
    ledger = incremental.Ledger(spark, "file://" + str(tmp_path / "ledger"), ["k"], "v", "at")
    schema = "k string, v int, at timestamp_ntz"
    seen = []
    numbers = []

    def take(df, n):
        numbers.append(n)
        seen.extend((r.k, r.v) for r in df.collect())

    data = [("a", 1, T0), ("b", 1, T0), ("b", 1, T0)]
    assert ledger.run(spark.createDataFrame(data, schema), take, "2025-01-01 00:00:00") == 1
    data += [("c", 1, T0 + timedelta(hours=2)), ("a", 2, T0 + timedelta(hours=1)), (None, None, None)]

    def crash(df, n):
        numbers.append(n)
        df.count()
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(spark.createDataFrame(data, schema), crash, "2025-01-01 03:00:00")
    assert ledger.state()["run"] == 1
    assert ledger.run(spark.createDataFrame(data, schema), take, "2025-01-01 01:30:00") == 2
    data.append(("late", 1, T0 + timedelta(hours=1, minutes=40)))  # after the oldest open transaction of the last run
    ledger.run(spark.createDataFrame(data, schema), take, "2025-01-01 05:00:00")
    ledger.run(spark.createDataFrame(data, schema), take, "2025-01-01 05:00:00")
    assert sorted(seen, key=repr) == sorted([("a", 1), ("b", 1), ("c", 1), ("a", 2), (None, None), ("late", 1)], key=repr)
    assert numbers[:3] == [1, 2, 2]  # a run that failed is repeated under its number
    names = [p.name for p in (tmp_path / "ledger").iterdir()]
    assert not [n for n in names if n.startswith("rows-")]
    # what lies before the watermark is not read again; many parts become one
    ledger.MOST_PARTS = 2
    for i in range(5):
        data.append((f"n{i}", 1, T0 + timedelta(hours=6 + i)))
        ledger.run(spark.createDataFrame(data, schema), take, f"2025-01-01 {5 + i:02d}:30:00")
    assert len(seen) == len(set(seen)) == 11 and len(ledger.state()["parts"]) <= 3
    with pytest.raises(RuntimeError, match="another writer"):
        ledger._commit(ledger.state())
