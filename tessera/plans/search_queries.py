"""Queries over the whole search, the facts of files, and state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import facts, graph, ingest, lexical, recent, resolve, search, store, symbols, usage
from tessera.plans.index_queries import _bm25_sql, _chunks, _usage
from tessera.session import cut_lineage
from tessera.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _index(spark, folder) -> search.Index:
    chunks = _chunks(spark, folder, "code", "breadcrumb")
    found = cut_lineage(symbols.definitions(chunks))
    vectors = table(spark, folder, "chunk_vectors", "chunk_id", "model", "dim", "vector").where("vector is not null and size(vector) = dim")
    one = vectors.groupBy("chunk_id").agg(F.min_by("vector", F.struct("model", "dim")).alias("vector"))
    return search.Index(chunks, table(spark, folder, "blobs", "blob_hash", "active"), found, cut_lineage(graph.call_edges(found, symbols.calls(chunks))), one)


def _asked(spark, folder) -> DataFrame:
    return table(spark, folder, "eval_items", "item_id", "text").select(F.col("item_id").alias("qid"), F.col("text").alias("query")).where("query is not null")


@query()
def search_hybrid(spark, folder):
    """All channels, fusion, expansion and packing for every evaluation item; tests work a small index out by hand."""
    return search.search(_index(spark, folder), _asked(spark, folder), search.Settings(budget=800)).select("qid", "chunk_id", "score", "tokens", "place", "source")


@query()
def search_hybrid_reranked(spark, folder):
    """The same with a second stage: a pool of the channels' heads by the query's words a passage holds (a stand-in for a model)."""
    settings = search.Settings(budget=800, use_router=False, expand=False, score=lambda pairs: [len({*q.split()} & {*p.split()}) - 2.0 for q, p in pairs])
    return search.search(_index(spark, folder), _asked(spark, folder), settings).select("qid", "chunk_id", "score", "tokens", "place", "source")


@query()
def search_replies(spark, folder):
    """Replies of a lexical search, trimmed to 300 tokens."""
    index = _index(spark, folder)
    found = search.search(index, _asked(spark, folder), search.Settings(budget=800, channels=("bm25",), expand=False, use_router=False))
    return search.replies(search.result_rows(found, index.chunks), 300).select("qid", "place", "chunk_id", "path", "score", "truncated")


_ACTIVE = "live AS (SELECT DISTINCT lower(blob_hash) AS h FROM blobs WHERE active AND blob_hash IS NOT NULL)"


@query(
    f"""WITH {_ACTIVE}, docs0 AS (SELECT chunk_id, min(blob_hash) AS blob_hash, min(concat_ws(' ', breadcrumb, code)) AS text FROM chunks GROUP BY 1),
{_bm25_sql("text").replace("FROM documents", "FROM docs0").replace("doc_id", "chunk_id").replace(
    "ranked AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scored)",
    "ranked AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE chunk_id IN (SELECT chunk_id FROM docs0 WHERE lower(blob_hash) IN (SELECT h FROM live)))")}
SELECT qid, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10"""
)
def search_active_only(spark, folder):
    """BM25 over chunks of active blobs; what is inactive still counts in the statistics."""
    chunks = _chunks(spark, folder, "code", "breadcrumb")
    once = chunks.groupBy("chunk_id").agg(F.min("blob_hash").alias("blob_hash"), F.min(F.concat_ws(" ", "breadcrumb", "code")).alias("text"))
    live = store.active_only(once, table(spark, folder, "blobs", "blob_hash", "active"))
    return lexical.bm25(once, _asked(spark, folder), "chunk_id", "text", k=10, active=live, active_on="chunk_id")


@query(
    """SELECT DISTINCT c.chunk_id AS qid, c.chunk_id, true AS found, c.code, c.byte_start, c.byte_end FROM chunks c
UNION ALL SELECT chunk_id || '?' AS qid, chunk_id || '?' AS chunk_id, false, NULL, NULL, NULL FROM (SELECT DISTINCT chunk_id FROM chunks)"""
)
def search_expand_by_id(spark, folder):
    """Every chunk by its id, active or not, and as many ids that name none."""
    chunks = _chunks(spark, folder, "code").select("chunk_id", "code", "byte_start", "byte_end")
    ids = chunks.select("chunk_id").distinct()
    asked = ids.select(F.col("chunk_id").alias("qid"), "chunk_id").unionByName(ids.select(F.concat("chunk_id", F.lit("?")).alias("qid"), F.concat("chunk_id", F.lit("?")).alias("chunk_id")))
    return store.get_chunks(chunks, asked).select("qid", "chunk_id", "found", "code", "byte_start", "byte_end")


@query(
    """SELECT blob_hash, chunk_id, byte_start, byte_end, CAST(row_number() OVER (PARTITION BY blob_hash ORDER BY byte_start, byte_end, chunk_id) AS INTEGER) AS place
FROM (SELECT DISTINCT blob_hash, chunk_id, byte_start, byte_end FROM chunks WHERE blob_hash IN (SELECT blob_hash FROM blobs))"""
)
def store_chunks_of_blobs(spark, folder):
    return store.chunks_of_blobs(_chunks(spark, folder), table(spark, folder, "blobs", "blob_hash"))


@query(f"WITH {_ACTIVE} SELECT DISTINCT chunk_id FROM chunks WHERE lower(blob_hash) IN (SELECT h FROM live) AND chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE model = 'tern-embed-v2' AND vector IS NOT NULL)")
def store_missing_vectors(spark, folder):
    vectors = table(spark, folder, "chunk_vectors", "chunk_id", "model", "vector")
    return store.missing_vectors(_chunks(spark, folder), table(spark, folder, "blobs", "blob_hash", "active"), vectors, "tern-embed-v2").select("chunk_id").distinct()


@query(
    """WITH o AS (SELECT DISTINCT chunk_id, byte_start, byte_end FROM chunks WHERE byte_start = 0), n AS (SELECT chunk_id, byte_start, byte_end,
  row_number() OVER (PARTITION BY chunk_id ORDER BY byte_start, byte_end) AS rn FROM chunks)
SELECT chunk_id, byte_start, byte_end FROM o UNION ALL SELECT chunk_id, byte_start, byte_end FROM n WHERE rn = 1 AND chunk_id NOT IN (SELECT chunk_id FROM o)"""
)
def store_add_chunks(spark, folder):
    """First chunks are there; all are put in again."""
    every = table(spark, folder, "chunks", "chunk_id", "byte_start", "byte_end")
    return store.add_chunks(every.where("byte_start = 0").distinct(), every)


@query(
    """WITH f AS (SELECT ref, path, min(blob_hash) AS blob_hash FROM files GROUP BY 1, 2), r AS (SELECT DISTINCT ref FROM files WHERE mtime IS NOT NULL)
SELECT ref, path, blob_hash FROM f WHERE ref NOT IN (SELECT ref FROM r)
UNION ALL SELECT ref, path, min(blob_hash) FROM files WHERE mtime IS NOT NULL GROUP BY 1, 2"""
)
def store_map_files(spark, folder):
    """Refs with a modification time anywhere are delivered again, as the rows that have one."""
    rows = table(spark, folder, "files", "ref", "path", "blob_hash", "mtime")
    old = rows.groupBy("ref", "path").agg(F.min("blob_hash").alias("blob_hash"))
    return store.map_files(old, rows.where("mtime is not null"))


# ---- facts and the graph made of them


def _facts(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Facts of all blobs, and the files (repo, path, blob_hash) behind them as the chunks name them."""
    rows = table(spark, folder, "chunks", "blob_hash", "byte_start", "language", "code", "file_path", "repo")
    files = rows.select("repo", F.col("file_path").alias("path"), F.lower("blob_hash").alias("blob_hash")).where("blob_hash is not null").distinct()
    return facts.file_facts(rows), files


@query()
def graph_facts(spark, folder):
    """Sizes of the facts of each blob; tests work five languages out by hand."""
    found, _ = _facts(spark, folder)
    return found.select("blob_hash", "language", "size", *[F.size(c).alias(f"n_{c}") for c in ("defs", "imports", "calls", "refs")])


@query()
def graph_nodes(spark, folder):
    return resolve.symbols(*_facts(spark, folder)).select("node_id", "symbol", "kind", "repo", "path", "byte_start", "byte_end", "parent")


@query()
def graph_edges(spark, folder):
    return resolve.edges(*_facts(spark, folder))


@query()
def graph_imports(spark, folder):
    return resolve.import_targets(*_facts(spark, folder)).select("repo", "path", "module", "name", "target")


@query()
def graph_enclosing(spark, folder):
    """Every definition with the smallest one around it."""
    return resolve.containers(resolve.symbols(*_facts(spark, folder)))


@query()
def graph_references(spark, folder):
    """What refers to each class, type, interface and message."""
    found, files = _facts(spark, folder)
    nodes = resolve.symbols(found, files)
    names = nodes.where("kind in ('class', 'type', 'interface', 'message')").select(F.col("symbol").alias("name")).distinct().withColumn("qid", F.col("name"))
    return resolve.references(resolve.edges(found, files), names, nodes)


# ---- queries for operators of the retrieval path


@query(
    """WITH w AS (SELECT item_id AS qid, list_distinct(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: length(x) > 3)) AS ws, text FROM eval_items),
s AS (SELECT qid, unnest(ws) AS term FROM w), r AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, term) AS rn FROM s)
SELECT qid, term FROM r WHERE rn <= 5"""
)
def text_longest_words(spark, folder):
    """What the fuzzy channel asks for where a query names nothing."""
    return symbols.fuzzy_terms(_asked(spark, folder), names=False)


@query(
    """SELECT item_id AS qid, list_sort(list_distinct(list_filter(list_transform(string_split_regex(text, '[^A-Za-z]+'), lambda x: lower(x)), lambda x: length(x) > 2))) AS terms
FROM (SELECT item_id, regexp_replace(regexp_replace(text, '[^a-z ]', ' ', 'g'), ' +', ' ', 'g') AS text FROM eval_items)"""
)
def text_query_terms(spark, folder):
    """Terms of the items' small letters, which no name rule cuts."""
    plain = F.regexp_replace(F.regexp_replace("text", "[^a-z ]", " "), " +", " ")
    return table(spark, folder, "eval_items", "item_id", "text").select(F.col("item_id").alias("qid"), text.query_terms(plain).alias("terms"))


@query("SELECT doc_id, contains(text, chr(0)) AS binary FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) <= 8192")
def ingest_binary(spark, folder):
    """Texts within the sniffed length; a longer one is judged by its first 8 KiB."""
    docs = table(spark, folder, "documents", "doc_id", "text").where(F.octet_length("text") <= ingest.SNIFFED_BYTES)
    return docs.select("doc_id", ingest.is_binary(F.encode("text", "UTF-8")).alias("binary"))


@query(
    """WITH u AS (SELECT event_type AS tool, value AS latency_ms, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-02')
SELECT tool, count(*) AS calls, round(median(latency_ms), 6) AS p50 FROM u GROUP BY 1"""
)
def usage_since(spark, folder):
    rows = usage.since(_usage(spark, folder), "2024-01-02")
    return rows.groupBy("tool").agg(F.count("*").alias("calls"), F.round(usage.p50("latency_ms"), 6).alias("p50"))


@query(
    """WITH u AS (SELECT event_type AS path_taken, value AS latency_ms, event_type = 'view' AS expanded FROM events)
SELECT CASE WHEN path_taken = 'view' THEN 'n/a' ELSE path_taken END AS path_taken, count(*) AS calls, round(avg(latency_ms), 6) AS avg_latency FROM u GROUP BY 1"""
)
def usage_by_path(spark, folder):
    rows = _usage(spark, folder).withColumn("path_taken", F.when(F.col("tool") != "view", F.col("tool")))
    return usage.path_report(rows)


@query(
    """WITH c AS (SELECT DISTINCT chunk_id, blob_hash, byte_end - byte_start AS n FROM chunks), s AS (SELECT blob_hash, max(size_bytes) AS size FROM blobs GROUP BY 1),
t AS (SELECT blob_hash AS qid, CAST(sum(n // 4) AS BIGINT) AS served_tokens FROM c GROUP BY 1)
SELECT qid, served_tokens, CAST(size // 4 AS BIGINT) AS spanned_tokens, CAST(greatest(0, size // 4 - served_tokens) AS BIGINT) AS avoided FROM t JOIN s ON s.blob_hash = qid WHERE size IS NOT NULL"""
)
def usage_savings(spark, folder):
    """Each blob as a call that served its chunks."""
    c = _chunks(spark, folder)
    served = c.select(F.col("blob_hash").alias("qid"), "blob_hash", F.floor((F.col("byte_end") - F.col("byte_start")) / 4).alias("tokens"))
    sizes = table(spark, folder, "blobs", "blob_hash", "size_bytes").groupBy("blob_hash").agg(F.max("size_bytes").alias("size_bytes")).where("size_bytes is not null")
    return usage.savings(served, sizes).withColumn("avoided", F.col("avoided").cast("long"))


@query(
    """WITH b AS (SELECT CAST(run_id % 7 AS INTEGER) AS line, epoch(finished_at) - epoch(started_at) AS s FROM (SELECT DISTINCT * FROM sync_runs) WHERE finished_at IS NOT NULL)
SELECT line, count(*) AS runs, CASE WHEN sum(s) > 0 THEN round(count(*) / sum(s), 9) END AS per_second FROM b GROUP BY 1"""
)
def usage_throughput(spark, folder):
    """Runs a second of their own time, in seven groups."""
    runs = table(spark, folder, "sync_runs").distinct().where("finished_at is not null")
    spent = (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return runs.groupBy((F.col("run_id") % 7).cast("int").alias("line")).agg(F.count("*").alias("runs"), F.round(usage.per_second(F.count("*"), F.sum(spent)), 9).alias("per_second"))


@query("SELECT substr(sha, 1, 12) AS sha, count(*) AS n FROM (SELECT DISTINCT * FROM commit_log) GROUP BY 1")
def history_short_commits(spark, folder):
    return table(spark, folder, "commit_log").distinct().groupBy(F.substring("sha", 1, 12).alias("sha")).agg(F.count("*").alias("n"))


@query()
def history_symbol_diffs(spark, folder):
    """Symbols that each snapshot added, removed or modified, by the facts of its blobs."""
    found, _ = _facts(spark, folder)
    files = table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at")
    return recent.symbol_diffs(files, table(spark, folder, "commit_log", "repo", "branch", "ordinal", "sha"), found)


@query(
    """SELECT repo, branch, substr(sha, 1, 12) AS sha, committed_at, author, message, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY committed_at DESC, ordinal DESC) AS rank FROM (SELECT DISTINCT * FROM commit_log) WHERE committed_at >= TIMESTAMP '2025-10-01') WHERE rank <= 5"""
)
def history_commits_since(spark, folder):
    return recent.recent_commits(table(spark, folder, "commit_log"), "2025-10-01", 5)
