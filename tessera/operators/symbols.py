"""Symbols: definitions seen in code, lookups, and the router for queries that name one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import identifier_tokens, path_segments

#: Declarations that stand at the start of a line; group 1 is the name.
DECLARATIONS = {
    "class": r"(?m)^[ \t]*(?:export |default |abstract )*class +([A-Za-z_]\w*)",
    "function": r"(?m)^[ \t]*(?:export |default |async )*(?:def|function\*?|func) +(?:\([^)\n]*\) *)?([A-Za-z_]\w*)",
    "interface": r"(?m)^[ \t]*(?:export )?interface +([A-Za-z_]\w*)",
    "message": r"(?m)^[ \t]*(?:message|service|enum) +([A-Za-z_]\w*)",
    "type": r"(?m)^[ \t]*(?:export )?type +([A-Za-z_]\w*)",
}
CALL = r"([A-Za-z_]\w*)\("


def definitions(chunks: DataFrame) -> DataFrame:
    """(symbol, kind, blob_hash, chunk_id, path, byte_start): declarations in code, once a chunk."""
    base = chunks.where("code is not null and language <> 'text'")
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all("code", F.lit(rx), F.lit(1))).alias("names"))
            for k, rx in DECLARATIONS.items()
        ]
    )
    return (
        base.select("blob_hash", "chunk_id", F.col("file_path").alias("path"), "byte_start", F.explode(kinds).alias("d"))
        .select("blob_hash", "chunk_id", "path", "byte_start", F.col("d.kind").alias("kind"), F.explode("d.names").alias("symbol"))
        .distinct()
    )


def calls(chunks: DataFrame) -> DataFrame:
    """(chunk_id, path, name): names called in a chunk, once each."""
    base = chunks.where("code is not null and language <> 'text'")
    return base.select("chunk_id", F.col("file_path").alias("path"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(CALL), F.lit(1)))).alias("name")).distinct()


def symbol_search(symbols: DataFrame, names: DataFrame, limit: int = 20) -> DataFrame:
    """(qid, symbol, chunk_id, path, rank): symbols that contain the name, letter case aside.

    Exact ones first, then those that begin with it, then by length, name, path
    and chunk.  Names of three letters or more meet the symbols by an equi-join of
    their first trigram with all trigrams; there are so few shorter ones that
    symbols are joined with all their runs of one and two letters instead.
    """
    low = symbols.withColumn("_low", F.lower("symbol"))
    asked = names.where(F.length("name") > 0).select("qid", F.lower("name").alias("_name"))
    asked = asked.withColumn("_g", F.substring("_name", 1, 3))

    def grams(n: int):
        return F.transform(F.sequence(F.lit(1), F.length("_low") - (n - 1)), lambda i: F.substring(F.col("_low"), i, F.lit(n)))

    runs = F.array_distinct(F.flatten(F.array(*[F.when(F.length("_low") >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)])))
    met = low.withColumn("_g", F.explode(runs)).join(asked, "_g").drop("_g").where(F.contains("_low", "_name"))
    tier = F.when(F.col("_low") == F.col("_name"), 0).when(F.col("_low").startswith(F.col("_name")), 1).otherwise(2)
    order = Window.partitionBy("qid").orderBy(tier, F.length("symbol"), "symbol", "path", "chunk_id", "kind")
    return (
        met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "symbol", "chunk_id", "path", "rank")
    )


def get_definitions(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, symbol, kind, path, chunk_id, score, rank): exact, case-sensitive, by path and place."""
    order = Window.partitionBy("qid").orderBy("path", "byte_start", "chunk_id", "kind")
    met = symbols.join(names.select("qid", F.col("name").alias("symbol")), "symbol")
    ranked = met.withColumn("rank", F.row_number().over(order))
    return ranked.select("qid", "symbol", "kind", "path", "chunk_id", F.round(F.greatest(F.lit(0.0), 1 - 0.05 * (F.col("rank") - 1)), 6).alias("score"), "rank")


def route(symbols: DataFrame, queries: DataFrame, fanout: int = 3, ambiguous: int = 8) -> DataFrame:
    """(qid, token, chunk_id, score): queries that name a definition, answered by definitions alone.

    Tokens with at most ``ambiguous`` definitions come first, then those with
    fewer, then by place in the query; of each up to ``fanout`` definitions, those
    on a path that the query mentions first.  A chunk is kept once, by its first token.
    """
    asked = queries.select("qid", "query", F.posexplode(identifier_tokens(F.col("query"))).alias("at", "token"))
    paths = queries.select("qid", path_segments(F.col("query")).alias("segments"))
    met = asked.join(symbols.withColumnRenamed("symbol", "token"), "token").join(paths, "qid")
    per_token = Window.partitionBy("qid", "token")
    affinity = F.when(F.exists("segments", lambda s: F.col("path").endswith(s)), 2).when(
        F.exists("segments", lambda s: F.col("path").contains(s)), 1
    ).otherwise(0)
    inner = per_token.orderBy(F.desc("affinity"), "path", "byte_start", "chunk_id", "kind")
    found = (
        met.withColumn("affinity", affinity)
        .withColumn("n", F.count("*").over(per_token))
        .withColumn("rank", F.row_number().over(inner) - 1)
        .where(F.col("rank") < fanout)
    )
    tiers = (
        found.select("qid", "token", "at", "n").distinct()
        .withColumn("tier", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("n") > ambiguous, "n", "at")) - 1)
        .select("qid", "token", "tier")
    )
    scored = found.join(tiers, ["qid", "token"]).withColumn(
        "score",
        F.round(F.greatest(F.lit(0.05), F.greatest(F.lit(0.1), 1 - 0.12 * F.col("tier")) - 0.04 * F.col("rank")), 6),
    )
    first = Window.partitionBy("qid", "chunk_id").orderBy("tier", "rank")
    return scored.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("qid", "token", "chunk_id", "score")


def fuzzy_terms(queries: DataFrame, most: int = 5, names: bool = True) -> DataFrame:
    """(qid, term): the first identifier tokens, or without any (or ``names``) the longest words of over three letters."""
    tokens = identifier_tokens(F.col("query"))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.col("query"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 3))
    longest = F.transform(F.slice(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, most), lambda x: x["w"])
    return queries.select("qid", F.explode(F.when(F.lit(names) & (F.size(tokens) > 0), F.slice(tokens, 1, most)).otherwise(longest)).alias("term"))
