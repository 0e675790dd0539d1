"""What changed between consecutive full snapshots.

Keys get persistent ordinals, dense within containers of 65,536 keys.  A
snapshot is then, for each block of 64 ordinals, one machine word of presence
bits and the values of the set bits in ordinal order; blocks without a file take
no row, which is what keeps the bitmap compressed.  ``new & ~old`` are the
additions, ``old & ~new`` the removals, and the value vectors, read at the bits
of ``new & old``, show the changes.

All snapshots of one block lie together, ordered by history, so each is compared
with the one before by looking back one row.  The key of that exchange is the
block, never the repository or the snapshot: a task meets 64 keys at a time,
however many a repository has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import normal_path
from tessera.session import cut_lineage

#: Keys of one container; a group has as many containers as its keys fill.
CONTAINER = 1 << 16
#: Rows of a history (one a snapshot) up to which it is broadcast, at some 150 bytes each; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
_WORD = 64
_NONE = "\u0000"  # stands for a null group, which joins would lose


def snapshot_records(files: DataFrame) -> DataFrame:
    """(repo, ref, path, blob_hash) of the files each snapshot holds.

    Of the rows of one (ref, path) the latest by loaded_at holds; a null hash
    there means that the path is no file.  Rows without ref or path are no
    records; a null loaded_at is older than any time; of rows with one
    loaded_at the greater hash holds, null being the least.
    """
    latest = (
        files.where(F.col("ref").isNotNull() & F.col("path").isNotNull())
        .select(
            "repo",
            "ref",
            normal_path(F.col("path")).alias("path"),
            F.struct("loaded_at", F.lower("blob_hash").alias("blob_hash")).alias("version"),
        )
        .groupBy("ref", "path")
        .agg(F.max("version").alias("version"), F.min("repo").alias("repo"))
    )
    return latest.select(
        F.coalesce("repo", F.lit("")).alias("repo"), "ref", "path", F.col("version.blob_hash").alias("blob_hash")
    ).where("blob_hash is not null")


def beside(rows: DataFrame, table: DataFrame, on: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join with a table that was written before; broadcast only if it has at most ``most`` rows."""
    return rows.join(F.broadcast(table) if table.limit(most + 1).count() <= most else table, on)


def assign_ordinals(keys: DataFrame, group: str, key: str, known: DataFrame | None = None, container: int = CONTAINER) -> DataFrame:
    """(group, key, ordinal): ordinals are dense in each container of a group.

    The container is the high part of the ordinal, so the numbering of one hot
    group is spread over tasks, yet words of 64 ordinals fill up.  ``known`` keeps
    its ordinals; new keys are numbered after the highest one of their container.
    """
    distinct = keys.select(group, key).distinct()
    sizes = distinct.groupBy(group).agg(F.ceil(F.count("*") / container).alias("_n"))
    numbered = distinct if known is None else distinct.join(known, [group, key], "left_anti")
    fresh = numbered.join(sizes, group).withColumn("_c", F.pmod(F.xxhash64(key), F.col("_n")))
    if known is not None:
        top = known.groupBy(group, F.shiftright("ordinal", 32).alias("_c")).agg(
            (F.max(F.col("ordinal").bitwiseAND(F.lit((1 << 32) - 1))) + 1).alias("_base")
        )
        fresh = fresh.join(top, [group, "_c"], "left")
    base = F.coalesce("_base", F.lit(0)) if known is not None else F.lit(0)
    order = Window.partitionBy(group, "_c").orderBy(key)
    numbered = fresh.select(group, key, (F.shiftleft(F.col("_c").cast("long"), 32) + base + F.row_number().over(order) - 1).alias("ordinal"))
    return numbered if known is None else known.select(group, key, "ordinal").unionByName(numbered)


def ordinal_blocks(records: DataFrame, by: list[str], seq: list[str], ordinal: str = "ordinal", value: str = "blob_hash") -> DataFrame:
    """(by, block, seq, bits, vals): presence word and values in ordinal order, 64 ordinals a block.

    ``by`` and the block are the partitioning, so what follows along ``seq`` needs no other exchange.
    """
    position = F.col(ordinal).bitwiseAND(F.lit(_WORD - 1)).cast("int")
    return (
        records.select(*by, *seq, F.shiftright(ordinal, 6).alias("block"), position.alias("_at"), F.col(value).alias("_v"))
        .repartition(*by, "block")
        .groupBy(*by, "block", *seq)
        .agg(
            F.bit_or(F.expr("shiftleft(1L, _at)")).alias("bits"),
            F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias("vals"),
        )
    )


def block_changes(blocks: DataFrame, by: list[str], seq: str, last: str) -> DataFrame:
    """(by, seq, ordinal, change): each snapshot of a block against the one before.

    ``last`` is the number of the group's last snapshot.  A block without a row
    at a number holds no key there: what it held before is removed at the number
    after its row, and all it holds is added where it comes again.
    """
    order = Window.partitionBy(*by, "block").orderBy(seq)
    here = F.struct(F.col(seq).alias("seq"), "bits", "vals")
    seen = blocks.select(*by, "block", F.col(seq).alias("_at_seq"), F.col(last).alias("_last"), here.alias("n"), F.lag(here).over(order).alias("o"), F.lead(seq).over(order).alias("_next"))
    nothing = F.struct(F.lit(0).cast("int").alias("seq"), F.lit(0).cast("long").alias("bits"), F.array().cast("array<string>").alias("vals"))
    follows = F.col("o.seq") == F.col("n.seq") - 1
    against = F.struct(F.col("n.seq").alias("seq"), F.col("n").alias("n"), F.when(follows, F.col("o")).otherwise(nothing).alias("o"))
    gone = F.struct((F.col("n.seq") + 1).alias("seq"), nothing.alias("n"), F.col("n").alias("o"))
    ends = (F.col("n.seq") < F.col("_last")) & (F.col("_next").isNull() | (F.col("_next") > F.col("n.seq") + 1))
    pairs = F.concat(F.when(F.col("n.seq") > 1, F.array(against)).otherwise(F.array()), F.when(ends, F.array(gone)).otherwise(F.array()))
    compared = seen.select(*by, "block", F.explode(pairs).alias("_p")).select(*by, "block", "_p.seq", "_p.n", "_p.o").where("n.bits <> o.bits or n.vals <> o.vals")
    words = {
        "added": F.col("n.bits").bitwiseAND(F.bitwise_not("o.bits")),
        "removed": F.col("o.bits").bitwiseAND(F.bitwise_not("n.bits")),
        "common": F.col("n.bits").bitwiseAND(F.col("o.bits")),
    }
    bit = lambda word: f"({word} & shiftleft(1L, x)) <> 0"
    rank = lambda side: f"element_at({side}.vals, cast(bit_count({side}.bits & ~shiftleft(-1L, x)) + 1 as int))"
    kind = f"case when {bit('added')} then 'added' when {bit('removed')} then 'removed' when {bit('common')} then case when {rank('n')} <> {rank('o')} then 'modified' end end"
    marks = F.expr(f"filter(transform(sequence(0, {_WORD - 1}), x -> named_struct('at', x, 'change', {kind})), y -> y.change is not null)")
    found = compared.withColumns(words).select(*by, "block", "seq", F.explode(marks).alias("_m"))
    return found.select(*by, F.col("seq"), (F.shiftleft("block", 6) + F.col("_m.at")).alias("ordinal"), F.col("_m.change").alias("change"))


def snapshot_history(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, branch, ref, seq, last): the commits that have rows in files, numbered by ordinal; ``last`` is a branch's last number."""
    refs = files.select("ref").where("ref is not null").distinct()
    named = commits.select(F.coalesce("repo", F.lit(_NONE)).alias("repo"), F.coalesce("branch", F.lit(_NONE)).alias("branch"), "ordinal", F.col("sha").alias("ref"))
    present = named.distinct().join(refs, "ref", "left_semi")
    whole = Window.partitionBy("repo", "branch")
    return present.select(
        "repo", "branch", "ref", F.row_number().over(whole.orderBy("ordinal", "ref")).alias("seq"), F.count("*").over(whole).cast("int").alias("last")
    )


def snapshot_changes(files: DataFrame, commits: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(ref, path, change) of every snapshot against the previous one of its branch.

    ``change`` is added, removed or modified.  The first snapshot of a branch
    has no rows.  A commit whose rows were all withdrawn is an empty snapshot.
    Empty tables give no rows; a branch without snapshots gives none.  A ref on
    two branches is compared on each; equal rows come out once.  ``known`` are
    the ordinals (repo, path, ordinal) of an earlier delivery.

    Rows are shuffled twice: by path, where the valid row of each (ref, path) is
    told and the ordinal joined, and by block.
    """
    history = cut_lineage(snapshot_history(files, commits))
    rows = files.where(F.col("ref").isNotNull() & F.col("path").isNotNull()).select(
        "ref", normal_path(F.col("path")).alias("path"), "loaded_at", F.lower("blob_hash").alias("blob_hash")
    )
    placed = beside(rows, history, ["ref"])
    ordinals = cut_lineage(assign_ordinals(placed.select("repo", "path"), "repo", "path", known))  # what a next delivery goes on from
    records = (
        placed.select("repo", "path", "branch", "seq", "last", F.struct("loaded_at", "blob_hash").alias("version"))
        .repartition("repo", "path")
        .groupBy("repo", "path", "branch", "seq", "last")
        .agg(F.max("version")["blob_hash"].alias("blob_hash"))
        .where("blob_hash is not null")
    )
    located = records.join(ordinals, ["repo", "path"]).select("repo", "branch", "seq", "last", "ordinal", "blob_hash")
    changes = block_changes(ordinal_blocks(located, ["repo", "branch"], ["seq", "last"]), ["repo", "branch"], "seq", "last")
    named = changes.join(ordinals, ["repo", "ordinal"])
    return beside(named, history.select("repo", "branch", "seq", "ref"), ["repo", "branch", "seq"]).select("ref", "path", "change").distinct()
