"""Queries over the index tables: ingest, chunking, search, fusion, packing, graph, usage, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import chunking, evalkit, fusion, graph, ingest, lexical, packing, rerank, symbols, usage, vectors
from tessera.operators.snapshots import snapshot_records
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


def _chunks(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(spark, folder, "chunks", "chunk_id", "blob_hash", "byte_start", "byte_end", "file_path", "language", *more).distinct()


def _records_sql() -> str:
    path = r"regexp_replace(replace(path, '\', '/'), '^\./', '')"
    return f"""records AS (SELECT repo, ref, path, blob_hash FROM (
      SELECT repo, ref, {path} AS path, lower(blob_hash) AS blob_hash,
        row_number() OVER (PARTITION BY ref, {path} ORDER BY loaded_at DESC NULLS LAST, lower(blob_hash) DESC NULLS LAST) AS rn
      FROM files WHERE ref IS NOT NULL AND path IS NOT NULL) WHERE rn = 1 AND blob_hash IS NOT NULL)"""


# ---- ingest


@query(
    "SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS blob_hash FROM documents WHERE text IS NOT NULL"
)
def ingest_blob_hash(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return docs.select("doc_id", ingest.blob_hash(F.encode("text", "UTF-8")).alias("blob_hash"))


_FOLDERS = ", ".join(f"'{x}'" for x in ingest.SKIPPED_FOLDERS)
_LOCKS = ", ".join(f"'{x}'" for x in ingest.LOCK_FILES)
_MINIFIED = " OR ".join(f"path LIKE '%{x}'" for x in ingest.MINIFIED_SUFFIXES)


@query(
    f"""WITH {_records_sql()}, sized AS (SELECT lower(blob_hash) AS blob_hash, max(size_bytes) AS size FROM blobs GROUP BY 1)
SELECT DISTINCT repo, path,
  coalesce(size, 0) > {ingest.MOST_BYTES}
  OR list_has_any(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), [{_FOLDERS}])
  OR regexp_extract(path, '([^/]*)$', 1) IN ({_LOCKS}) OR {_MINIFIED} OR path LIKE 'docs/%.md' AS skipped
FROM records LEFT JOIN sized USING (blob_hash)"""
)
def ingest_skip_rules(spark, folder):
    records = snapshot_records(table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at"))
    sizes = table(spark, folder, "blobs", "blob_hash", "size_bytes").groupBy(F.lower("blob_hash").alias("blob_hash")).agg(F.max("size_bytes").alias("size"))
    rule = ingest.matches_ignore(F.col("path"), ["# own rules", "/docs/*.md"])
    return records.join(sizes, "blob_hash", "left").select("repo", "path", ingest.is_skipped(F.col("path"), F.col("size"), rule).alias("skipped")).distinct()


_LANG_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ingest.LANGUAGES.items())


@query(
    f"""WITH {_records_sql()}
SELECT DISTINCT path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) {_LANG_CASES} ELSE 'text' END AS language,
  regexp_extract(path, '^(.*)/[^/]*$', 1) AS package,
  CASE WHEN path LIKE '%.py' THEN replace(regexp_replace(regexp_replace(path, '\\.py$', ''), '(^|/)__init__$', ''), '/', '.')
       ELSE regexp_replace(path, '\\.[^./]*$', '') END AS module
FROM records"""
)
def ingest_languages(spark, folder):
    records = snapshot_records(table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at"))
    p = F.col("path")
    return records.select("path", ingest.language_of(p).alias("language"), paths.package_of(p).alias("package"), paths.module_name(p).alias("module")).distinct()


@query(f"WITH {_records_sql()} SELECT blob_hash, min(path) AS path, count(DISTINCT path) AS n_paths FROM records GROUP BY 1")
def ingest_first_paths(spark, folder):
    return ingest.first_paths(snapshot_records(table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at")))


_NEWEST = """newest AS (SELECT repo, branch, max_by(sha, ordinal) AS ref FROM (
  SELECT DISTINCT repo, branch, ordinal, sha FROM commit_log WHERE sha IN (SELECT ref FROM files)) GROUP BY 1, 2)"""


@query(
    f"""WITH {_records_sql()}, {_NEWEST},
want AS (SELECT DISTINCT blob_hash FROM records JOIN newest USING (ref)),
have AS (SELECT blob_hash, bool_or(coalesce(active, false)) AS active FROM blobs WHERE blob_hash IS NOT NULL GROUP BY 1)
SELECT coalesce(h.blob_hash, w.blob_hash) AS blob_hash,
  CASE WHEN h.blob_hash IS NULL THEN 'index' WHEN w.blob_hash IS NOT NULL THEN 'reactivate' ELSE 'deactivate' END AS action
FROM have h FULL OUTER JOIN want w ON w.blob_hash = h.blob_hash
WHERE h.blob_hash IS NULL OR (w.blob_hash IS NOT NULL AND NOT h.active) OR (w.blob_hash IS NULL AND h.active)"""
)
def ingest_activation(spark, folder):
    files = table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at")
    commits = table(spark, folder, "commit_log", "repo", "branch", "ordinal", "sha").distinct()
    newest = (
        commits.join(files.select(F.col("ref").alias("sha")).distinct(), "sha", "left_semi")
        .groupBy("repo", "branch").agg(F.max_by("sha", "ordinal").alias("ref"))
    )
    want = snapshot_records(files).join(newest.select("ref"), "ref", "left_semi")
    return ingest.activation(table(spark, folder, "blobs", "blob_hash", "active"), want)


@query(
    """WITH latest AS (SELECT count(DISTINCT blob_hash) FILTER (WHERE active) AS active_blobs, count(DISTINCT blob_hash) AS all_blobs FROM blobs),
f AS (SELECT count(*) AS n_commits, max(committed_at) AS last_commit FROM (SELECT DISTINCT * FROM commit_log)),
s AS (SELECT max(finished_at) AS last_sync FROM sync_runs WHERE status = 'ok'),
m AS (SELECT count(*) AS missing_vectors FROM (SELECT DISTINCT chunk_id FROM chunks) c WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE vector IS NOT NULL))
SELECT * FROM latest, f, s, m"""
)
def index_status(spark, folder):
    blobs = table(spark, folder, "blobs", "blob_hash", "active")
    a = blobs.agg(F.count_distinct(F.when(F.col("active"), F.col("blob_hash"))).alias("active_blobs"), F.count_distinct("blob_hash").alias("all_blobs"))
    f = table(spark, folder, "commit_log").distinct().agg(F.count("*").alias("n_commits"), F.max("committed_at").alias("last_commit"))
    s = table(spark, folder, "sync_runs", "status", "finished_at").where("status = 'ok'").agg(F.max("finished_at").alias("last_sync"))
    chunks = table(spark, folder, "chunks", "chunk_id").distinct()
    m = vectors.missing_vectors(chunks, table(spark, folder, "chunk_vectors", "chunk_id", "vector")).agg(F.count("*").alias("missing_vectors"))
    return a.crossJoin(f).crossJoin(s).crossJoin(m)  # four single rows


# ---- chunking

_LINES = r"""
WITH t AS (SELECT doc_id, octet_length(encode(text)) AS size, string_split(text, chr(10)) AS parts, text LIKE '%' || chr(10) AS closed
           FROM documents WHERE text IS NOT NULL AND text <> ''),
l AS (SELECT doc_id, size, list_transform(CASE WHEN closed THEN parts[1:len(parts)-1] ELSE parts END, lambda x: octet_length(encode(x)) + 1) AS n FROM t),
k AS (SELECT doc_id, size, n, len(n) AS k FROM l),
w AS (SELECT doc_id, size, n, k, unnest(range(0, CAST(greatest(0, ceil((k - {w}) / {s}.0)) * {s} AS BIGINT) + 1, {s})) AS st FROM k),
b AS (SELECT doc_id, CAST(st + 1 AS INTEGER) AS line_start, CAST(least(st + {w}, k) AS INTEGER) AS line_end,
        coalesce(list_sum(n[1:st]), 0) AS b, least(list_sum(n[1:least(st + {w}, k)]), size) AS e FROM w)
SELECT doc_id, CAST(byte_start AS INTEGER) AS byte_start, CAST(least(byte_start + {cap}, e) AS INTEGER) AS byte_end, line_start, line_end
FROM (SELECT *, unnest(range(CAST(b AS BIGINT), CAST(e AS BIGINT), {cap})) AS byte_start FROM b)
"""


@query(_LINES.format(w=20, s=15, cap=16384))
def chunk_line_windows(spark, folder):
    return chunking.line_windows(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", 20, 5)


@query(_LINES.format(w=7, s=5, cap=300))
def chunk_line_windows_capped(spark, folder):
    return chunking.line_windows(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", 7, 2, 300)


def _structural(spark, folder) -> DataFrame:
    files = chunking.whole_files(table(spark, folder, "chunks", "blob_hash", "byte_start", "language", "code"))
    return chunking.structural_chunks(files, "blob_hash", "text", "language", start="byte_start")


@query()
def chunk_structural(spark, folder):
    """Structure needs a parser, so SQL has no counterpart; ``chunk_coverage`` and tests check that the chunks partition every blob."""
    return _structural(spark, folder).select("blob_hash", "byte_start", "byte_end", "breadcrumb", "tainted")


@query(
    """SELECT lower(blob_hash) AS blob_hash, CAST(min(byte_start) AS INTEGER) AS first_byte, CAST(max(byte_end) AS INTEGER) AS last_byte, CAST(max(byte_end) AS BIGINT) AS covered
FROM chunks WHERE code IS NOT NULL GROUP BY 1 HAVING max(byte_end) > 0"""
)
def chunk_coverage(spark, folder):
    """The bytes that the structural chunks of each blob cover: all of it, once."""
    cut = _structural(spark, folder).groupBy("blob_hash")
    return cut.agg(F.min("byte_start").alias("first_byte"), F.max("byte_end").alias("last_byte"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("covered"))


# ---- text and vector search



def _tok(col: str) -> str:
    return f"regexp_extract_all(translate(lower({col}), '{text._ACCENTED}', '{text._FOLDED}'), '[\\p{{L}}\\p{{N}}_]+')"


def _bm25_sql(words: str, k: int = 10) -> str:
    return f"""terms AS (SELECT doc_id, unnest({_tok("text")}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT sum(dl) FROM dl) AS n_terms),
q AS (SELECT qid, term, count(*) AS q_tf FROM (SELECT item_id AS qid, unnest({_tok(words)}) AS term FROM eval_items) GROUP BY 1, 2),
w AS (SELECT qid, term, q_tf, CASE WHEN n_docs - df + 0.5 > df + 0.5 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, n_terms / n_docs AS avgdl
      FROM q JOIN df USING (term), n),
scored AS (SELECT qid, doc_id, round(sum(q_tf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75 * dl / avgdl))), 9) AS score
      FROM w JOIN tf USING (term) JOIN dl USING (doc_id) GROUP BY 1, 2),
ranked AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored)"""


_HEAD = "text"
_TAIL = "regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g')"


def _asked(spark, folder, tail: bool = False) -> DataFrame:
    """The whole text of every evaluation item, or its ASCII words alone."""
    text_ = F.regexp_replace("text", "[^A-Za-z0-9_]+", " ") if tail else F.col("text")
    return table(spark, folder, "eval_items", "item_id", "text").select(F.col("item_id").alias("qid"), text_.alias("query"))


def _items(spark, folder) -> DataFrame:
    """Every evaluation item with its whole text."""
    return table(spark, folder, "eval_items", "item_id", "text").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query(f"WITH {_bm25_sql(_HEAD)} SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10")
def search_bm25(spark, folder):
    return lexical.bm25(table(spark, folder, "documents", "doc_id", "text"), _asked(spark, folder), "doc_id", "text", k=10)


@query(
    f"""WITH a AS (WITH {_bm25_sql(_HEAD)} SELECT * FROM ranked WHERE rank <= 30), b AS (WITH {_bm25_sql(_TAIL)} SELECT * FROM ranked WHERE rank <= 30),
f AS (SELECT qid, doc_id, round(sum(part), 9) AS score FROM (
  SELECT qid, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM a UNION ALL SELECT qid, doc_id, 2.0::DOUBLE / (60 + rank) FROM b) GROUP BY 1, 2)
SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 20"""
)
def search_fused(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    a, b = (lexical.bm25(docs, _asked(spark, folder, tail), "doc_id", "text", k=30) for tail in (False, True))
    return fusion.rrf([a, b], "doc_id", weights=[1.0, 2.0], limit=20)


@query(
    f"""WITH a AS (WITH {_bm25_sql(_HEAD)} SELECT * FROM ranked WHERE rank <= 30), b AS (WITH {_bm25_sql(_TAIL)} SELECT * FROM ranked WHERE rank <= 30),
f AS (SELECT qid, doc_id, round(sum(part), 9) AS score FROM (
  SELECT qid, doc_id, 1.0::DOUBLE / (60 + rank) AS part FROM a UNION ALL SELECT qid, doc_id, 1.0::DOUBLE / (60 + rank) FROM b) GROUP BY 1, 2),
fr AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f),
u AS (SELECT qid, doc_id, 0 AS o, rank FROM a WHERE rank <= 8 UNION ALL SELECT qid, doc_id, 1, rank FROM b WHERE rank <= 8 UNION ALL SELECT qid, doc_id, 2, rank FROM fr),
d AS (SELECT qid, doc_id, min(o * 1000000 + rank) AS pos FROM u GROUP BY 1, 2)
SELECT qid, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY pos, doc_id) AS place FROM d) WHERE place <= 20"""
)
def search_rerank_pool(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    a, b = (lexical.bm25(docs, _asked(spark, folder, tail), "doc_id", "text", k=30) for tail in (False, True))
    return fusion.rerank_pool([(a, 8), (b, 8)], fusion.rrf([a, b], "doc_id"), "doc_id")


@query(
    """WITH s AS (SELECT q.vec_id AS qid, e.vec_id, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id AND len(e.embedding) = len(q.embedding) WHERE q.vec_id % 100 = 0)
SELECT qid, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
)
def search_vectors(spark, folder):
    """Every vector whose id is divisible by 100, against all."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    asked = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), "embedding")
    return vectors.top_k(e, asked, "vec_id", "embedding", exclude_self=True)


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(u[1], 6) AS first FROM (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"""
)
def vectors_normalised(spark, folder):
    u = table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", F.explode(F.array(vectors.normalised(F.col("embedding")))).alias("u"))
    return u.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("u"), F.col("u"))), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


@query(
    """SELECT repo, count(*) AS missing FROM (SELECT DISTINCT chunk_id, repo FROM chunks) c
WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE vector IS NOT NULL) GROUP BY 1"""
)
def vectors_missing(spark, folder):
    chunks = table(spark, folder, "chunks", "chunk_id", "repo").distinct()
    return vectors.missing_vectors(chunks, table(spark, folder, "chunk_vectors", "chunk_id", "vector")).groupBy("repo").agg(F.count("*").alias("missing"))


# ---- functions on queries and code


@query(
    r"""WITH t AS (SELECT item_id, text, list_filter(list_transform(string_split_regex(text, '[^A-Za-z0-9_]+'), lambda w: ltrim(w, '0123456789')), lambda w: length(w) >= 3) AS toks,
  list_transform(list_concat(list_concat(regexp_extract_all(text, '(\w+)\s*\(', 1), regexp_extract_all(text, '[.:](\w+)', 1)), regexp_extract_all(text, '\((\*?\w+)\)', 1)), lambda w: ltrim(w, '*0123456789')) AS placed FROM eval_items),
k AS (SELECT item_id, list_filter(toks, lambda x: contains(x, '_') OR regexp_matches(x, '[0-9]') OR regexp_matches(x[2:], '[A-Z]') OR list_contains(placed, x) OR x = trim(text)) AS kept FROM t),
u AS (SELECT item_id, unnest(kept) AS token, generate_subscripts(kept, 1) AS pos FROM k)
SELECT item_id, token, CAST(row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) AS INTEGER) AS place FROM u GROUP BY item_id, token"""
)
def text_identifiers(spark, folder):
    q = table(spark, folder, "eval_items", "item_id", "text")
    return q.select("item_id", F.posexplode(text.identifier_tokens(F.col("text"))).alias("p", "token")).select("item_id", "token", (F.col("p") + 1).alias("place"))


_SPLIT = "list_transform(regexp_extract_all(regexp_replace(regexp_replace({0}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), lambda y: lower(y))"


@query(
    f"""WITH s AS (SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS token FROM eval_items) WHERE token <> '')
SELECT token, array_to_string({_SPLIT.format("token")}, ' ') AS words FROM s"""
)
def text_split_identifiers(spark, folder):
    q = table(spark, folder, "eval_items", "text")
    names = q.select(F.explode(F.split("text", "[^A-Za-z0-9_]+")).alias("token")).where("token <> ''").distinct()
    return names.select("token", F.array_join(text.split_identifier(F.col("token")), " ").alias("words"))


@query(
    rf"""WITH r AS (SELECT doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9_./-]+')) AS run FROM documents),
p AS (SELECT doc_id, rtrim(trim(piece, '/'), '.') AS piece FROM (SELECT doc_id, unnest(string_split_regex(run, '//+')) AS piece FROM r)),
n AS (SELECT doc_id, CASE WHEN contains(piece, '/') THEN piece ELSE regexp_extract(piece, '([^.]+\.(?:{text.FILE_SUFFIXES}))(?:[.-].*)?$', 1) END AS segment FROM p)
SELECT DISTINCT doc_id, segment FROM n WHERE length(segment) >= 4"""
)
def text_path_segments(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "text")
    return docs.select("doc_id", F.explode(text.path_segments(F.col("text"))).alias("segment")).distinct()


@query(
    """SELECT DISTINCT chunk_id, CAST(greatest(1, ceil(length(code) / 4.0) + floor((length(code) - length(replace(code, chr(10), ''))) / 4.0)) AS INTEGER) AS packing_tokens,
  CAST(greatest(1, floor((length(code) + 3) / 4.0)) AS INTEGER) AS reply_tokens FROM chunks WHERE code IS NOT NULL"""
)
def text_token_estimates(spark, folder):
    c = table(spark, folder, "chunks", "chunk_id", "code").where("code is not null")
    return c.select("chunk_id", text.retrieval_tokens(F.col("code")).alias("packing_tokens"), text.tool_tokens(F.col("code")).alias("reply_tokens")).distinct()


# ---- symbols and graph

_DEFS = (
    "defs AS ("
    + " UNION ALL ".join(
        f"SELECT DISTINCT blob_hash, chunk_id, file_path AS path, byte_start, '{k}' AS kind, unnest(regexp_extract_all(code, '{rx}', 1)) AS symbol FROM chunks WHERE code IS NOT NULL AND language <> 'text'"
        for k, rx in symbols.DECLARATIONS.items()
    )
    + "), symbols AS (SELECT DISTINCT * FROM defs)"
)


def _symbols(spark, folder) -> DataFrame:
    return symbols.definitions(_chunks(spark, folder, "code"))


def _names(found: DataFrame) -> DataFrame:
    """Every class name is a query; it is its own id."""
    return found.where("kind = 'class'").select(F.col("symbol").alias("name")).distinct().withColumn("qid", F.col("name"))


_NAMES = "names AS (SELECT DISTINCT symbol AS name, symbol AS qid FROM symbols WHERE kind = 'class')"


@query(f"WITH {_DEFS} SELECT symbol, kind, blob_hash, chunk_id, path, byte_start FROM symbols")
def graph_definitions(spark, folder):
    return _symbols(spark, folder)


@query(
    f"""WITH {_DEFS}, asked AS (SELECT DISTINCT substr(symbol, 1, 7) AS name, substr(symbol, 1, 7) AS qid FROM symbols WHERE kind = 'class'),
m AS (SELECT qid, symbol, chunk_id, path, row_number() OVER (PARTITION BY qid ORDER BY
  CASE WHEN lower(symbol) = lower(name) THEN 0 WHEN starts_with(lower(symbol), lower(name)) THEN 1 ELSE 2 END, length(symbol), symbol, path, chunk_id, kind) AS rank
  FROM symbols JOIN asked ON contains(lower(symbol), lower(name)))
SELECT qid, symbol, chunk_id, path, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 20"""
)
def graph_symbol_search(spark, folder):
    found = _symbols(spark, folder)
    asked = found.where("kind = 'class'").select(F.substring("symbol", 1, 7).alias("name")).distinct().withColumn("qid", F.col("name"))
    return symbols.symbol_search(found, asked)


@query(
    f"""WITH {_DEFS}, {_NAMES}
SELECT qid, symbol, kind, path, chunk_id, round(greatest(0.0::DOUBLE, 1 - 0.05::DOUBLE * (rank - 1)), 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT qid, symbol, kind, path, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY path, byte_start, chunk_id, kind) AS rank FROM symbols JOIN names ON name = symbol)"""
)
def graph_get_definition(spark, folder):
    found = _symbols(spark, folder)
    return symbols.get_definitions(found, _names(found))


_GENERIC = ", ".join(f"'{x}'" for x in graph.GENERIC_NAMES)
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(path, '{rx}') THEN '{k}'" for k, rx in graph._ENDINGS.items()) + " ELSE 'other' END"
_EDGES = f"""{_DEFS}, sites AS (SELECT DISTINCT chunk_id, path, name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS package, {_FAMILY} AS family FROM (
  SELECT chunk_id, file_path AS path, unnest(regexp_extract_all(code, '{symbols.CALL}', 1)) AS name FROM chunks WHERE code IS NOT NULL AND language <> 'text')),
d AS (SELECT symbol, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS package, {_FAMILY} AS family, arg_min(chunk_id, (byte_start, chunk_id)) AS chunk_id FROM symbols GROUP BY 1, 2, 3, 4),
pk AS (SELECT symbol, family, package, arg_min(chunk_id, (path, chunk_id)) AS pkg_dst FROM d GROUP BY 1, 2, 3),
un AS (SELECT symbol, family, min(chunk_id) AS only_dst FROM d GROUP BY 1, 2 HAVING count(*) = 1),
edges AS (SELECT DISTINCT src, dst, 'CALLS' AS kind FROM (
  SELECT s.chunk_id AS src, coalesce(d.chunk_id, CASE WHEN s.name NOT IN ({_GENERIC}) THEN coalesce(pkg_dst, only_dst) END) AS dst
  FROM sites s LEFT JOIN d ON d.symbol = s.name AND d.path = s.path LEFT JOIN pk ON pk.symbol = s.name AND pk.family = s.family AND pk.package = s.package LEFT JOIN un ON un.symbol = s.name AND un.family = s.family)
  WHERE dst IS NOT NULL AND src <> dst)"""


def _edges(spark, folder) -> DataFrame:
    chunks = _chunks(spark, folder, "code")
    return graph.call_edges(symbols.definitions(chunks), symbols.calls(chunks))


@query(f"WITH {_EDGES} SELECT src, dst, kind FROM edges")
def graph_call_edges(spark, folder):
    return _edges(spark, folder)


_FUNCS = "names AS (SELECT DISTINCT symbol AS name, symbol AS qid FROM symbols WHERE kind = 'function')"


@query(
    f"""WITH {_EDGES}, {_FUNCS}, targets AS (SELECT DISTINCT qid, chunk_id AS dst, regexp_extract(path, '^(.*)/[^/]*$', 1) AS pkg FROM names JOIN symbols ON symbol = name),
inc AS (SELECT qid, src, count(DISTINCT dst) AS n, list(DISTINCT pkg) AS pkgs FROM edges JOIN targets USING (dst) GROUP BY 1, 2),
p AS (SELECT DISTINCT chunk_id AS src, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS src_pkg FROM chunks),
r AS (SELECT qid, src AS chunk_id, n, row_number() OVER (PARTITION BY qid ORDER BY list_contains(pkgs, src_pkg) DESC, n DESC, src) AS rank FROM inc JOIN p USING (src))
SELECT qid, chunk_id, n, round(greatest(0.0::DOUBLE, 1 - 0.03::DOUBLE * (rank - 1)), 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"""
)
def graph_callers(spark, folder):
    chunks = _chunks(spark, folder, "code")
    found = symbols.definitions(chunks)
    names = found.where("kind = 'function'").select(F.col("symbol").alias("name")).distinct().withColumn("qid", F.col("name"))
    return graph.callers(found, graph.call_edges(found, symbols.calls(chunks)), chunks, names)


@query(
    f"""WITH {_EDGES} SELECT DISTINCT dst AS node, src AS neighbour, 'caller' AS relation, 0 AS priority FROM edges
UNION ALL SELECT DISTINCT src, dst, 'callee', 1 FROM edges"""
)
def graph_neighbours(spark, folder):
    edges = _edges(spark, folder)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return graph.neighbours(edges, nodes)


@query(
    f"""WITH {_EDGES}, wanted AS (SELECT DISTINCT symbol, chunk_id FROM symbols WHERE kind IN ('function', 'class', 'method') AND length(symbol) >= 3),
c AS (SELECT dst AS chunk_id, count(*) AS n FROM edges GROUP BY 1)
SELECT symbol, CAST(sum(coalesce(n, 0)) AS BIGINT) AS refs FROM wanted LEFT JOIN c USING (chunk_id) GROUP BY 1 ORDER BY refs DESC, symbol LIMIT 20"""
)
def graph_most_referenced(spark, folder):
    return graph.most_referenced(_symbols(spark, folder), _edges(spark, folder))


_SPANS = "spans AS (SELECT DISTINCT chunk_id AS span_id, blob_hash, byte_start + 100 AS a, byte_end + 100 AS b FROM chunks), ch AS (SELECT DISTINCT blob_hash, chunk_id, byte_start, byte_end FROM chunks)"


def _spans(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Spans that begin and end 100 bytes after a chunk, so most lie across two."""
    c = _chunks(spark, folder)
    return c.select(F.col("chunk_id").alias("span_id"), "blob_hash", (F.col("byte_start") + 100).alias("byte_start"), (F.col("byte_end") + 100).alias("byte_end")), c


@query(
    f"""WITH {_SPANS} SELECT span_id, chunk_id, overlap FROM (SELECT span_id, chunk_id, least(b, byte_end) - greatest(a, byte_start) AS overlap,
  row_number() OVER (PARTITION BY span_id ORDER BY least(b, byte_end) - greatest(a, byte_start) DESC, byte_start, byte_end, chunk_id) AS rn
  FROM spans JOIN ch USING (blob_hash) WHERE least(b, byte_end) > greatest(a, byte_start)) WHERE rn = 1"""
)
def graph_best_overlap(spark, folder):
    return graph.best_overlap(*_spans(spark, folder))


@query(
    f"""WITH {_SPANS} SELECT span_id, chunk_id FROM (SELECT span_id, chunk_id,
  row_number() OVER (PARTITION BY span_id ORDER BY (byte_start <= a AND b <= byte_end) DESC,
    CASE WHEN byte_start <= a AND b <= byte_end THEN byte_end - byte_start ELSE -(least(b, byte_end) - greatest(a, byte_start)) END, byte_start, chunk_id) AS rn
  FROM spans JOIN ch USING (blob_hash) WHERE least(b, byte_end) > greatest(a, byte_start)) WHERE rn = 1"""
)
def graph_smallest_container(spark, folder):
    return graph.smallest_container(*_spans(spark, folder))


@query(
    f"""WITH {_records_sql()}, imp AS (SELECT DISTINCT file_path AS src_path, unnest(regexp_extract_all(code, '(?m)^(?:from|import) +([A-Za-z_][\\w.]*)', 1)) AS module
  FROM chunks WHERE language = 'python' AND code IS NOT NULL),
tried AS (SELECT src_path, module, 0 AS p, replace(module, '.', '/') || '.py' AS dst_path FROM imp UNION ALL SELECT src_path, module, 1, replace(module, '.', '/') || '/__init__.py' FROM imp),
pathed AS (SELECT DISTINCT regexp_extract(path, '([^/]*)$', 1) AS dst_path FROM records)
SELECT DISTINCT src_path, dst_path FROM (SELECT src_path, module, arg_min(dst_path, p) AS dst_path FROM tried JOIN pathed USING (dst_path) GROUP BY 1, 2) WHERE src_path <> dst_path"""
)
def graph_python_imports(spark, folder):
    """Every folder counts as a root for modules, as the invented imports name no package of their own."""
    records = snapshot_records(table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at"))
    held = records.select(paths.base_name(F.col("path")).alias("path"))
    return graph.python_imports(_chunks(spark, folder, "code"), held)


@query(
    f"""WITH {_DEFS}, {_NAMES}, asked AS (SELECT qid, name FROM names),
met AS (SELECT qid, s.*, count(*) OVER (PARTITION BY qid) AS n, row_number() OVER (PARTITION BY qid ORDER BY path, byte_start, chunk_id, kind) - 1 AS rank
  FROM asked JOIN symbols s ON s.symbol = name),
sc AS (SELECT qid, symbol AS token, chunk_id, rank, round(greatest(0.05::DOUBLE, 1 - 0.04::DOUBLE * rank), 6) AS score FROM met WHERE rank < 3)
SELECT qid, token, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY rank) AS k FROM sc) WHERE k = 1"""
)
def graph_router(spark, folder):
    found = _symbols(spark, folder)
    return symbols.route(found, _names(found).withColumnRenamed("name", "query"))


@query()
def search_packed(spark, folder):
    """BM25 hits of every item over the chunks, packed into 800 tokens; tests compare the fold with a plain loop."""
    chunks = _chunks(spark, folder, "code", "breadcrumb")
    hits = lexical.bm25(chunks, _items(spark, folder), "chunk_id", "breadcrumb", "code", k=30)
    rows = hits.join(chunks, "chunk_id").withColumn("tokens", text.retrieval_tokens(F.col("code")))
    return packing.pack(rows, 800)


@query()
def search_expanded(spark, folder):
    """One hop from the best BM25 chunks, at a discount; tests check it on a small graph."""
    chunks = _chunks(spark, folder, "code", "breadcrumb")
    hits = lexical.bm25(chunks, _items(spark, folder), "chunk_id", "breadcrumb", "code", k=20)
    return graph.expand(hits, graph.call_edges(symbols.definitions(chunks), symbols.calls(chunks)))


# ---- usage and evaluation


def _usage(spark, folder) -> DataFrame:
    e = table(spark, folder, "events", "ts", "event_type", "value", "props")
    return e.select(
        "ts", F.col("event_type").alias("tool"), F.col("value").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        (F.col("event_type") == "view").alias("expanded"),
    )


@query(
    """WITH u AS (SELECT event_type AS tool, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, event_type = 'view' AS expanded FROM events)
SELECT tool, count(*) AS calls, round(avg(latency_ms), 6) AS avg_latency, list_sort(list(latency_ms))[CAST(least(count(*) - 1, floor(count(*) * 0.95)) AS BIGINT) + 1] AS p95_latency,
  CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE expanded) AS expands FROM u GROUP BY 1"""
)
def usage_by_tool(spark, folder):
    return usage.tool_report(_usage(spark, folder))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS tool, count(*) AS calls FROM events GROUP BY 1, 2")
def usage_daily(spark, folder):
    return usage.daily_calls(_usage(spark, folder))


_P95 = {"usage": "least(n - 1, floor(n * 0.95))", "eval": "greatest(0, floor(n * 0.95) - 1)", "support": "least(n - 1, floor((n - 1) * 0.95 + 0.999))"}


@query(
    "WITH g AS (SELECT event_type AS tool, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT tool, '{k}' AS rule, v[CAST({x} AS BIGINT) + 1] AS latency_ms FROM g" for k, x in _P95.items())
)
def usage_percentiles(spark, folder):
    rows, out = _usage(spark, folder), None
    for rule, pick in (("usage", usage.p95_usage), ("eval", usage.p95_eval), ("support", usage.p95_support)):
        part = usage.percentile_at(rows, ["tool"], "latency_ms", pick).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out.select("tool", "rule", "latency_ms")


@query(
    f"""WITH {_bm25_sql(_HEAD)}, r AS (SELECT * FROM ranked WHERE rank <= 10),
heads AS (SELECT item_id AS qid, item_type AS type, array_to_string({_tok("text")}[1:5], ' ') AS head FROM eval_items),
runs AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS head FROM (SELECT doc_id, {_tok("text")} AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
gold AS (SELECT DISTINCT qid, type, doc_id FROM heads JOIN runs USING (head)),
h AS (SELECT g.qid, g.type, min(rank) AS rank FROM gold g LEFT JOIN r ON r.qid = g.qid AND r.doc_id = g.doc_id GROUP BY 1, 2)
SELECT type, count(*) AS n, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr,
  round(avg(CASE WHEN rank <= 5 THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr_at_k FROM h GROUP BY 1"""
)
def eval_recall(spark, folder):
    """Gold are the documents that hold an item's first five words in a row, met by an equi-join on them."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    items = table(spark, folder, "eval_items", "item_id", "item_type", "text")
    first = F.array_join(F.slice(text.search_tokens(F.col("text")), 1, 5), " ")
    heads = items.select(F.col("item_id").alias("qid"), F.col("item_type").alias("type"), first.alias("head"))
    words = lexical.tokenised(docs, "doc_id", "text").where(F.size("tokens") >= 5)
    fives = F.transform(F.sequence(F.lit(1), F.size("tokens") - 4), lambda i: F.array_join(F.slice("tokens", i, 5), " "))
    gold = words.select("doc_id", F.explode(fives).alias("head")).join(heads, "head").select("qid", "type", "doc_id").distinct()
    return evalkit.quality(lexical.bm25(docs, _asked(spark, folder), "doc_id", "text", k=10), gold, "doc_id")


@query(
    """WITH c AS (SELECT DISTINCT * FROM commit_log)
SELECT repo, branch, sha, committed_at, message FROM (SELECT *, row_number() OVER (PARTITION BY repo, branch ORDER BY committed_at DESC, ordinal DESC) AS rn FROM c
  WHERE committed_at >= TIMESTAMP '2025-12-01') WHERE rn <= 20"""
)
def history_recent_commits(spark, folder):
    """The newest 20 commits of a branch since a date; a bare date is midnight UTC."""
    from pyspark.sql import Window

    c = table(spark, folder, "commit_log").distinct().where(F.col("committed_at") >= F.lit("2025-12-01").cast("timestamp_ntz"))
    order = Window.partitionBy("repo", "branch").orderBy(F.desc("committed_at"), F.desc("ordinal"))
    return c.withColumn("rn", F.row_number().over(order)).where("rn <= 20").select("repo", "branch", "sha", "committed_at", "message")


@query(
    f"""WITH {_DEFS}, t AS (SELECT symbol, kind, byte_start, chunk_id, path LIKE 'src/%' AS new FROM symbols),
o AS (SELECT symbol, kind, arg_max(chunk_id, (byte_start, chunk_id)) AS c FROM t WHERE NOT new GROUP BY 1, 2), n AS (SELECT symbol, kind, arg_max(chunk_id, (byte_start, chunk_id)) AS c FROM t WHERE new GROUP BY 1, 2)
SELECT symbol, kind, CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM o FULL OUTER JOIN n USING (symbol, kind) WHERE o.c IS NULL OR n.c IS NULL OR o.c <> n.c"""
)
def history_symbol_changes(spark, folder):
    """Definitions below src/ against all others, as two versions of one code base."""
    found = _symbols(spark, folder).withColumn("text", F.col("chunk_id")).withColumn("byte_start", F.struct("byte_start", "chunk_id"))
    return graph.symbol_changes(found.where("path not like 'src/%'"), found.where("path like 'src/%'"))


# ---- second stage and recency


@query()
def search_reranked(spark, folder):
    """BM25 pool of every item, reranked by how many of the query's words a passage holds (a stand-in for a model)."""
    chunks = _chunks(spark, folder, "code", "breadcrumb")
    asked = _items(spark, folder)
    hits = lexical.bm25(chunks, asked, "chunk_id", "breadcrumb", "code", k=20)
    rows = rerank.passages(hits.select("qid", "chunk_id", F.col("rank").alias("place")), asked, chunks)
    return rerank.blend(rerank.rerank(rows, lambda pairs: [len({*q.split()} & {*p.split()}) - 2.0 for q, p in pairs]), hits, table(spark, folder, "blobs", "blob_hash", "active"))


@query(
    f"""WITH {_records_sql()}, c AS (SELECT DISTINCT sha, ordinal, committed_at FROM commit_log)
SELECT path, max(committed_at) AS at_date FROM records JOIN c ON c.sha = ref GROUP BY 1"""
)
def history_last_changes(spark, folder):
    """When each path was last in a snapshot; commit times order the log over all branches."""
    records = snapshot_records(table(spark, folder, "files", "repo", "ref", "path", "blob_hash", "loaded_at"))
    commits = table(spark, folder, "commit_log", "sha", "committed_at").distinct()
    log = records.join(commits, records.ref == commits.sha).select("path", F.col("committed_at").alias("ordinal"), F.col("committed_at").alias("at_date"))
    return rerank.last_changes(log)


@query(
    f"""WITH {_EDGES}, n AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY 1),
ch AS (SELECT DISTINCT chunk_id, file_path AS path, byte_start FROM chunks),
pr AS (SELECT DISTINCT e.dst AS qid, e.src AS node, s.path, s.byte_start, t.path AS target_path FROM edges e JOIN ch s ON s.chunk_id = e.src JOIN ch t ON t.chunk_id = e.dst),
sc AS (SELECT qid, pr.node, path, byte_start, round(CASE WHEN path = target_path THEN 2 WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = regexp_extract(target_path, '^(.*)/[^/]*$', 1) THEN 1 ELSE 0 END * 1000
  + least(coalesce(n, 0), 99) * 10 + 0.2::DOUBLE, 6) AS score FROM pr LEFT JOIN n ON n.node = pr.node)
SELECT qid, node, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path, byte_start, node) AS rank FROM sc) WHERE rank <= 20"""
)
def graph_ranked_callers(spark, folder):
    """Callers of every chunk by proximity, use and recency; all paths count as changed 7,300 days after 2000."""
    chunks, edges = _chunks(spark, folder), _edges(spark, folder)
    at = chunks.select(F.col("chunk_id").alias("node"), F.col("file_path").alias("path"), "byte_start").distinct()
    target = chunks.select(F.col("chunk_id").alias("qid"), F.col("file_path").alias("target_path")).distinct()
    pairs = edges.select(F.col("dst").alias("qid"), F.col("src").alias("node")).join(at, "node").join(target, "qid").withColumn("at", F.lit(0))
    changed = chunks.select(F.col("file_path").alias("path"), F.lit("2019-12-27").cast("timestamp").alias("at_date")).distinct()
    return rerank.rank_related(pairs, graph.inbound_counts(edges).withColumnRenamed("dst", "node"), changed)
