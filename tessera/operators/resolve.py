"""From facts to a graph: symbols with their places, and edges by name resolution.

Every step is an equi-join on a name with its file, package, family or receiver;
choices among candidates are bounded aggregates.  Nothing pairs files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import package_of
from tessera.operators.facts import FAMILIES
from tessera.operators.graph import GENERIC_NAMES
from tessera.session import cut_lineage

#: What a relative import of a script may stand for, in this order.
SCRIPT_ENDS = (".ts", ".tsx", ".mts", ".js", ".jsx", ".mjs")


def _family(language: Column) -> Column:
    return F.coalesce(*[F.when(language == k, v) for k, v in FAMILIES.items()])


def _node(repo: Column | str, path: Column | str, start: Column | str) -> Column:
    """Id of a definition; start -1 is the module itself."""
    return F.concat_ws("#", repo, path, start)


def symbols(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(node_id, symbol, kind, repo, path, package, family, blob_hash, byte_start, byte_end, signature, parent), modules included.

    ``files`` are (repo, path, blob_hash): a blob on several paths has its symbols on each.
    """
    placed = facts.join(files.select("repo", "path", "blob_hash").distinct(), "blob_hash")
    module = F.array(F.struct(F.regexp_extract("path", r"([^/]*)$", 1).alias("symbol"), F.lit("module").alias("kind"), F.lit(-1).alias("byte_start"), F.col("size").alias("byte_end"), *[F.lit(None).cast("string").alias(c) for c in ("signature", "parent", "digest")]))
    rows = placed.select("repo", "path", "blob_hash", _family(F.col("language")).alias("family"), F.explode(F.concat(module, "defs")).alias("d"))
    return rows.select(
        _node("repo", "path", "d.byte_start").alias("node_id"), "d.symbol", "d.kind", "repo", "path", package_of(F.col("path")).alias("package"), "family", "blob_hash",
        "d.byte_start", "d.byte_end", "d.signature", "d.parent",
    )


def import_targets(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, module, name, alias, target): imports that name a file of the same repository.

    Python: dotted from the root, or relative by leading dots, as a file or a
    package, a name imported from a package also as its module.  Scripts: relative
    paths as they are, with a known ending, or as a folder's index.  Go: the
    longest tail of the import path that is the tail of a folder with Go files,
    its first file.  Proto: the exact path, else the only path with that tail.
    A file never imports itself.
    """
    held = files.select("repo", "path", "blob_hash").distinct()
    rows = facts.join(held, "blob_hash").select("repo", "path", _family(F.col("language")).alias("family"), package_of(F.col("path")).alias("package"), F.explode("imports").alias("i"))
    rows = rows.select("repo", "path", "family", "package", "i.module", "i.name", "i.alias").where("module is not null and module <> ''").distinct()
    known = held.select("repo", F.col("path").alias("target")).distinct()
    steps = F.split(F.when(F.col("package") == "", "").otherwise(F.col("package")), "/")

    # python
    py = rows.where("family = 'python'").withColumn("_up", F.length(F.regexp_extract("module", r"^(\.*)", 1)))
    rest = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
    base = F.when(F.col("_up") > 0, F.array_join(F.slice(steps, F.lit(1), F.greatest(F.lit(0), F.size(steps) - F.col("_up") + 1)), "/")).otherwise("")
    stem = F.concat_ws("/", F.when(base != "", base), F.when(rest != "", rest))
    joined = lambda *parts: F.concat_ws("/", *[F.when(p != "", p) for p in parts])
    py_tries = F.array(
        joined(stem, F.concat("name", F.lit(".py"))), joined(stem, F.concat("name", F.lit("/__init__.py"))), F.concat(stem, F.lit(".py")), joined(stem, F.lit("__init__.py"))
    )
    # scripts: a relative path folded by its dots
    script = rows.where("family = 'ecma' and module rlike '^[.]{1,2}(/|$)'")
    parts = F.concat(F.filter(steps, lambda s: s != ""), F.split("module", "/"))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p.isin(".", ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p))))
    to = F.array_join(folded, "/")
    bare = F.regexp_replace(to, r"\.(js|jsx|mjs)$", "")
    script_tries = F.array(to, *[F.concat(to, F.lit(e)) for e in SCRIPT_ENDS], *[F.concat(bare, F.lit(e)) for e in SCRIPT_ENDS], *[joined(to, F.lit("index" + e)) for e in SCRIPT_ENDS])
    first = (
        py.withColumn("tries", py_tries).drop("_up").unionByName(script.withColumn("tries", script_tries))
        .select("repo", "path", "module", "name", "alias", F.posexplode("tries").alias("order", "target"))
        .where("target is not null").join(known, ["repo", "target"])
    )
    # go: tails of the import path against tails of folders
    folders = held.where("path like '%.go'").groupBy("repo", package_of(F.col("path")).alias("folder")).agg(F.min("path").alias("target"))
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(F.split(c, "/"), F.size(F.split(c, "/")) - k + 1, k), "/").alias("tail")))
    go = rows.where("family = 'go'").select("repo", "path", "module", "name", "alias", F.explode(tails(F.col("module"))).alias("t")).select("*", "t.tail", (-F.col("t.n")).alias("order")).drop("t")
    folders = folders.select("repo", "target", F.explode(tails(F.col("folder"))).alias("t")).select("repo", "target", "t.tail")
    second = go.join(folders.groupBy("repo", "tail").agg(F.min("target").alias("target")), ["repo", "tail"]).drop("tail")
    # proto: a path, or the only one with that tail
    protos = held.where("path like '%.proto'").select("repo", F.col("path").alias("target")).distinct()
    ends = protos.select("repo", "target", F.explode(tails(F.col("target"))).alias("t")).groupBy("repo", F.col("t.tail").alias("module")).agg(F.min("target").alias("one"), F.count("*").alias("n"), F.max(F.when(F.col("target") == F.col("t.tail"), F.col("target"))).alias("same"))
    third = rows.where("family = 'proto'").join(ends, ["repo", "module"]).withColumn("target", F.coalesce("same", F.when(F.col("n") == 1, F.col("one")))).withColumn("order", F.lit(0)).where("target is not null")
    cols = ["repo", "path", "module", "name", "alias", "order", "target"]
    every = first.select(*cols).unionByName(second.select(*cols)).unionByName(third.select(*cols))
    return every.groupBy("repo", "path", "module", "name", "alias").agg(F.min_by("target", "order").alias("target")).where("target <> path")


def _best(rows: DataFrame, *by: str) -> DataFrame:
    """(by, node_id, n) of the definition that stands for a key: no method if there is another, the first by path and place; n counts places."""
    order = F.struct((F.col("kind") == "method").alias("m"), "path", "byte_start")
    return rows.groupBy(*by).agg(F.min_by("node_id", order).alias("node_id"), F.count_distinct("repo", "path", "byte_start").alias("n"))


def edges(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, kind) between nodes: DEFINES, IMPORTS, CALLS and REFERENCES, each once, none to itself.

    A call on a receiver whose type its file tells goes to that type's method or
    nowhere.  Any other name resolves within its file, else to what an import
    binds it to, else - unless it is a generic name - to the one definition of its
    package and family next to it, else to the only one of its family in the
    repository; otherwise it is dropped, never guessed.  Only definitions of the
    caller's own family count.
    """
    facts = cut_lineage(facts)  # read once, used for nodes, imports and sites
    nodes = symbols(facts, files)
    defs = nodes.where("kind <> 'module'").withColumnRenamed("symbol", "name")
    bound = import_targets(facts, files)
    placed = facts.join(files.select("repo", "path", "blob_hash").distinct(), "blob_hash")
    sites = [placed.select("repo", "path", "language", F.lit(kind).alias("kind"), F.explode(col).alias("s")) for col, kind in (("calls", "CALLS"), ("refs", "REFERENCES"))]
    asked = sites[0].unionByName(sites[1]).select(
        "repo", "path", package_of(F.col("path")).alias("package"), _family(F.col("language")).alias("family"), "kind", "s.name", "s.type", _node("repo", "path", "s.within").alias("src")
    ).distinct()
    own = _best(defs, "repo", "path", "name").select("repo", "path", "name", F.col("node_id").alias("own"))
    here = _best(defs, "repo", "family", "package", "name").select("repo", "family", "package", "name", F.col("node_id").alias("near"))
    only = _best(defs, "repo", "family", "name").where("n = 1").select("repo", "family", "name", F.col("node_id").alias("only"))
    method = _best(defs.where("parent is not null"), "repo", "family", "parent", "name").select("repo", "family", F.col("parent").alias("type"), "name", F.col("node_id").alias("method"))
    exported = own.withColumnsRenamed({"path": "target", "name": "what", "own": "imported"})
    via = bound.where("alias is not null").select("repo", "path", F.col("alias").alias("name"), F.coalesce("name", "alias").alias("what"), "target")
    via = via.join(exported, ["repo", "target", "what"]).groupBy("repo", "path", "name").agg(F.min("imported").alias("imported"))
    generic = F.col("name").isin(*GENERIC_NAMES)
    found = (
        asked.join(method, ["repo", "family", "type", "name"], "left").join(own, ["repo", "path", "name"], "left").join(via, ["repo", "path", "name"], "left")
        .join(here, ["repo", "family", "package", "name"], "left").join(only, ["repo", "family", "name"], "left")
    )
    by_name = F.coalesce("own", "imported", F.when(~generic, F.coalesce("near", "only")))
    dst = F.when(F.col("type").isNotNull(), F.col("method")).otherwise(by_name)
    used = found.select("src", dst.alias("dst"), "kind")
    held = nodes.where("kind <> 'module'").select(_node("repo", "path", F.lit(-1)).alias("src"), F.col("node_id").alias("dst"), F.lit("DEFINES").alias("kind"))
    imports = bound.select(_node("repo", "path", F.lit(-1)).alias("src"), _node("repo", "target", F.lit(-1)).alias("dst"), F.lit("IMPORTS").alias("kind"))
    return used.unionByName(held).unionByName(imports).where("dst is not null and src <> dst").distinct()


def containers(nodes: DataFrame) -> DataFrame:
    """(node_id, container): the smallest definition that strictly holds each one, else its module.

    Spans of a file nest, so a running look back over the starts would do, but a
    file's definitions are few: an equi-join on the file with the spans as residual.
    """
    inner = nodes.where("kind <> 'module'").select("repo", "path", "node_id", F.col("byte_start").alias("a"), F.col("byte_end").alias("b"))
    outer = nodes.select("repo", "path", F.col("node_id").alias("container"), "byte_start", "byte_end", "kind").where("kind <> 'const'")
    met = inner.join(outer, ["repo", "path"]).where("byte_start <= a and b <= byte_end and node_id <> container and (byte_start < a or b < byte_end)")
    return met.groupBy("node_id").agg(F.min_by("container", F.struct((F.col("byte_end") - F.col("byte_start")).alias("size"), (-F.col("byte_start")).alias("at"))).alias("container"))


def importers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, importer): modules by the modules that import them."""
    return edges.where("kind = 'IMPORTS'").select(F.col("dst").alias("target"), F.col("src").alias("importer"))


def references(edges: DataFrame, names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, node_id, relation): what refers to the definitions of a name, by a reference, a call or, of modules, an import."""
    wanted = nodes.join(names.select("qid", F.col("name").alias("symbol")), "symbol").select("qid", F.col("node_id").alias("dst"))
    met = edges.where(F.col("kind").isin("REFERENCES", "CALLS", "IMPORTS")).join(wanted, "dst")
    return met.select("qid", F.col("src").alias("node_id"), F.col("kind").alias("relation")).distinct()
