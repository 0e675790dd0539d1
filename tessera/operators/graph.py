"""The symbol graph: edges from names, and what the queries ask of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import package_of

#: Languages whose definitions may answer each other's calls, by the ending of a path; others stand for themselves.
_ENDINGS = {"py": r"(?i)\.pyi?$", "ecma": r"(?i)\.([mc]?ts|tsx|[mc]?js|jsx)$", "go": r"(?i)\.go$", "proto": r"(?i)\.proto$"}


def family(path):
    """The family of a file's language."""
    out = F.lit("other")
    for name, rx in _ENDINGS.items():
        out = F.when(path.rlike(rx), name).otherwise(out)
    return out


#: Method names of common built-in types, which never resolve by being unique.
GENERIC_NAMES = tuple(
    """
    get set items keys values append extend insert pop remove read write open
    split rsplit join strip lstrip rstrip lower upper format match sub search
    findall encode decode dumps loads sleep urlopen fetchall fetchone
    push shift unshift filter map reduce slice splice concat indexOf includes
    find findIndex forEach trim replace toString json getItem setItem
    removeItem getTime floor ceil round max min stringify parse log info warn
    error then catch finally resolve reject setTimeout
    String Error Len Close Write Read
    """.split()
)


def call_edges(symbols: DataFrame, sites: DataFrame) -> DataFrame:
    """(src, dst, kind): chunk to defining chunk, for every called name that resolves.

    A name resolves within its file, else to the one package it is defined in
    next to the caller, else to the only definition there is, unless it is a
    generic name; otherwise it is dropped, never guessed.  Only definitions of the
    caller's language family count.  Ties go to the first path and place.  Both sides are keyed by name, so resolution is one equi-join
    and the choice among definitions a bounded aggregate, not a pairing of files.
    """
    defs = symbols.groupBy("symbol", "path").agg(F.min(F.struct("byte_start", "chunk_id"))["chunk_id"].alias("chunk_id"))
    defs = defs.withColumns({"package": package_of(F.col("path")), "family": family(F.col("path"))})
    in_package = defs.groupBy("symbol", "family", "package").agg(F.min(F.struct("path", "chunk_id"))["chunk_id"].alias("pkg_dst"))
    unique = defs.groupBy("symbol", "family").agg(F.count("*").alias("n"), F.min("chunk_id").alias("only_dst")).where("n = 1")
    asked = sites.withColumns({"package": package_of(F.col("path")), "family": family(F.col("path"))}).withColumnRenamed("name", "symbol")
    resolved = (
        asked.join(defs.select("symbol", "path", F.col("chunk_id").alias("own_dst")), ["symbol", "path"], "left")
        .join(in_package, ["symbol", "family", "package"], "left")
        .join(unique.select("symbol", "family", "only_dst"), ["symbol", "family"], "left")
    )
    generic = F.col("symbol").isin(*GENERIC_NAMES)
    dst = F.coalesce("own_dst", F.when(~generic, F.coalesce("pkg_dst", "only_dst")))
    return (
        resolved.select(F.col("chunk_id").alias("src"), dst.alias("dst"), F.lit("CALLS").alias("kind"))
        .where("dst is not null and src <> dst")
        .distinct()
    )


def inbound_counts(edges: DataFrame, kinds: tuple[str, ...] = ("CALLS", "REFERENCES")) -> DataFrame:
    """(dst, n)."""
    return edges.where(F.col("kind").isin(*kinds)).groupBy("dst").agg(F.count("*").alias("n"))


def most_referenced(symbols: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """(symbol, refs): functions, classes and methods of three letters or more by incoming edges."""
    wanted = symbols.where(F.col("kind").isin("function", "class", "method") & (F.length("symbol") >= 3)).select("symbol", "chunk_id").distinct()
    counts = inbound_counts(edges).withColumnRenamed("dst", "chunk_id")
    return (
        wanted.join(counts, "chunk_id", "left").groupBy("symbol").agg(F.sum(F.coalesce("n", F.lit(0))).alias("refs"))
        .orderBy(F.desc("refs"), "symbol").limit(limit)
    )


def callers(symbols: DataFrame, edges: DataFrame, chunks: DataFrame, names: DataFrame, kind: str = "CALLS", limit: int = 20) -> DataFrame:
    """(qid, chunk_id, n, score, rank): chunks with an edge to a definition of the name.

    Those in a package that defines it first, then by edges, then by id; the
    limit comes before anything is looked up about the caller.
    """
    targets = names.join(symbols.withColumnRenamed("symbol", "name"), "name").select("qid", F.col("chunk_id").alias("dst"), package_of(F.col("path")).alias("pkg")).distinct()
    incoming = edges.where(F.col("kind") == kind).join(targets, "dst").groupBy("qid", "src").agg(F.count_distinct("dst").alias("n"), F.collect_set("pkg").alias("pkgs"))
    paths = chunks.select(F.col("chunk_id").alias("src"), package_of(F.col("file_path")).alias("src_pkg")).distinct()
    near = incoming.join(paths, "src").withColumn("near", F.array_contains("pkgs", F.col("src_pkg")))
    order = Window.partitionBy("qid").orderBy(F.desc("near"), F.desc("n"), "src")
    return (
        near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        .select("qid", F.col("src").alias("chunk_id"), "n", F.round(F.greatest(F.lit(0.0), 1 - 0.03 * (F.col("rank") - 1)), 6).alias("score"), "rank")
    )


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbour, relation, priority): one hop, callers before callees before importers before references."""
    asked = nodes.select("node").distinct()
    sides = [("CALLS", "dst", "src", "caller", 0), ("CALLS", "src", "dst", "callee", 1), ("IMPORTS", "dst", "src", "importer", 2), ("REFERENCES", "dst", "src", "reference", 3)]
    out = None
    for kind, at, to, relation, priority in sides:
        part = edges.where(F.col("kind") == kind).join(asked.withColumnRenamed("node", at), at).select(
            F.col(at).alias("node"), F.col(to).alias("neighbour"), F.lit(relation).alias("relation"), F.lit(priority).alias("priority")
        )
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def expand(results: DataFrame, edges: DataFrame, top: int = 10, discount: float = 0.6) -> DataFrame:
    """(qid, chunk_id, score, parent): neighbours of the first results that are not results, at a discount.

    Of several parents the best ranked one counts, then the order of relations.
    """
    heads = results.where(F.col("rank") <= top).select("qid", F.col("chunk_id").alias("node"), "score", "rank")
    near = neighbours(edges, heads).join(heads, "node").withColumnRenamed("neighbour", "chunk_id")
    fresh = near.join(results.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    first = Window.partitionBy("qid", "chunk_id").orderBy("rank", "priority", "node")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        "qid", "chunk_id", F.round(F.col("score") * discount, 6).alias("score"), F.col("node").alias("parent")
    )


def best_overlap(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(span_id, chunk_id, overlap): of the chunks of its blob the one a span shares most bytes with, the first on ties.

    An equi-join on the blob with the ranges as its residual; a blob's chunks are few.
    """
    met = spans.select("span_id", "blob_hash", F.col("byte_start").alias("a"), F.col("byte_end").alias("b")).join(
        chunks.select("blob_hash", "chunk_id", "byte_start", "byte_end").distinct(), "blob_hash"
    )
    shared = met.withColumn("overlap", F.least("b", "byte_end") - F.greatest("a", "byte_start")).where("overlap > 0")
    order = Window.partitionBy("span_id").orderBy(F.desc("overlap"), "byte_start", "byte_end", "chunk_id")
    return shared.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("span_id", "chunk_id", "overlap")


def smallest_container(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(span_id, chunk_id): the smallest chunk that holds the span, else the one it overlaps most."""
    met = spans.select("span_id", "blob_hash", F.col("byte_start").alias("a"), F.col("byte_end").alias("b")).join(
        chunks.select("blob_hash", "chunk_id", "byte_start", "byte_end").distinct(), "blob_hash"
    )
    holds = (F.col("byte_start") <= F.col("a")) & (F.col("b") <= F.col("byte_end"))
    shared = F.least("b", "byte_end") - F.greatest("a", "byte_start")
    size = F.when(holds, F.col("byte_end") - F.col("byte_start")).otherwise(-shared)
    order = Window.partitionBy("span_id").orderBy(F.desc(holds), size, "byte_start", "chunk_id")
    return met.where((F.least("b", "byte_end") - F.greatest("a", "byte_start")) > 0).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("span_id", "chunk_id")


def python_imports(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(src_path, dst_path): imports of Python files that name a file of the collection.

    A dotted module is looked up as a file and as a package, from the root.  The
    candidates are exploded with their priority and joined on the path.
    """
    found = chunks.where("language = 'python' and code is not null").select(
        F.col("file_path").alias("src_path"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"(?m)^(?:from|import) +([A-Za-z_][\w.]*)"), F.lit(1)))).alias("module")
    ).distinct()
    stem = F.translate("module", ".", "/")
    options = F.array(F.struct(F.lit(0).alias("p"), F.concat(stem, F.lit(".py")).alias("dst_path")), F.struct(F.lit(1).alias("p"), F.concat(stem, F.lit("/__init__.py")).alias("dst_path")))
    tried = found.select("src_path", "module", F.explode(options).alias("o")).select("src_path", "module", "o.p", "o.dst_path")
    met = tried.join(files.select(F.col("path").alias("dst_path")).distinct(), "dst_path")
    return met.groupBy("src_path", "module").agg(F.min_by("dst_path", "p").alias("dst_path")).select("src_path", "dst_path").where("src_path <> dst_path").distinct()


def symbol_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, kind, change) between two sets of definitions (symbol, kind, text): added, removed or modified.

    Of several definitions of one (symbol, kind) the last by place stands for it.
    """
    last = lambda df, to: df.groupBy("symbol", "kind").agg(F.max_by("text", "byte_start").alias(to))
    joined = last(old, "before").join(last(new, "after"), ["symbol", "kind"], "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    return joined.select("symbol", "kind", change.alias("change")).where("change is not null")
