"""The whole search on a small index, and state."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tessera.operators import lexical, rerank, search, store, usage

CHUNKS = "chunk_id string, blob_hash string, byte_start int, byte_end int, file_path string, breadcrumb string, code string"


def index(spark):
    c = [
        ("c1", "B1", 0, 40, "p/a.py", "# p/a.py :: load_rows", "def load_rows(path): return parse(path)"),
        ("c2", "b2", 0, 40, "p/b.py", "# p/b.py :: parse", "def parse(text): split lines of text"),
        ("c3", "b3", 0, 40, "q/c.py", "# q/c.py :: old_parse", "def old_parse(text): split lines of text again"),
        ("c4", "b4", 0, 40, "q/d.py", "", "banner of unrelated words"),
    ]
    c.append(c[0])
    blobs = spark.createDataFrame([("b1", True), ("b2", False), ("b2", True), ("b3", False), ("b4", True), ("b4", None)], "blob_hash string, active boolean")
    syms = spark.createDataFrame([("load_rows", "function", "p/a.py", "c1", 0), ("parse", "function", "p/b.py", "c2", 0), ("old_parse", "function", "q/c.py", "c3", 0)], "symbol string, kind string, path string, chunk_id string, byte_start int")
    edges = spark.createDataFrame([("c1", "c2", "CALLS"), ("c1", "c3", "CALLS")], "src string, dst string, kind string")
    vecs = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.6, 0.8]), ("c3", [0.0, 1.0]), ("c4", [0.0, 1.0])], "chunk_id string, vector array<float>")
    return search.Index(spark.createDataFrame(c, CHUNKS), blobs, syms, edges, vecs)


def test_search_by_hand(spark):
    ix = index(spark)
    asked = spark.createDataFrame([(1, "who calls load_rows please"), (2, "split lines of text"), (3, "nothing of this is there"), (4, "zzz")], "qid int, query string")
    got = {}
    for r in search.search(ix, asked).orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.source))
    # the router answers with the definition and its callee; c3 is inactive and never comes
    assert got[1] == [("c1", "router"), ("c2", "router")]
    assert got[2][0] == ("c2", "bm25") and ("c1", "graph") in got[2]
    assert 4 not in got and "c3" not in {c for rs in got.values() for c, _ in rs}
    qv = spark.createDataFrame([(2, [0.0, 1.0])], "qid int, vector array<float>")
    only = search.search(ix, asked, search.Settings(channels=("vector",), expand=False, use_router=False), qv)
    assert [(r.chunk_id, r.source) for r in only.orderBy("place").collect()] == [("c4", "vector"), ("c2", "vector"), ("c1", "vector")]
    second = search.search(ix, asked, search.Settings(expand=False, use_router=False, score=lambda ps: [5.0 if "parse(path)" in p else 0.0 for _, p in ps]), qv)
    assert {r.chunk_id for r in second.where("qid = 2").collect()} == {"c1", "c2", "c4"}
    tight = search.search(ix, asked.where("qid = 2"), search.Settings(budget=10, expand=False, use_router=False))
    assert tight.agg(F.sum("tokens")).first()[0] <= 10
    shown = search.result_rows(search.search(ix, asked.where("qid = 1")), ix.chunks, snippet=5)
    assert {r.code for r in shown.collect()} == {"def l\n...", "def p\n..."}
    assert [r.truncated for r in search.replies(shown, 60).collect()] == [1]
    assert search.search(ix, asked.limit(0)).count() == 0


def test_bm25_takes_any_number_of_queries_and_repeated_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9)) + (" É" if i % 5 == 0 else "")) for i in range(60)] + [(98, None), (99, "")], "d int, t string").withColumn("tokens", F.lit(1)).withColumn("key", F.lit(2))
    asked = spark.createDataFrame([(i, f"w{i % 17} w{i % 5} w{i % 5} e") for i in range(40)] + [(90, "unknown"), (91, None), (92, "")], "qid int, query string")
    want = rows(lexical.bm25(docs, asked, "d", "t", k=7))
    assert len(want) == 40 * 7
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 7)
    monkeypatch.setattr(lexical, "ROWS", 9)
    assert rows(lexical.bm25(docs, asked, "d", "t", k=7)) == want
    few = lexical.bm25(docs, asked, "d", "t", k=7, active=docs.where("d < 5"), active_on="d")
    full = {(r.qid, r.d): r.score for r in lexical.bm25(docs, asked, "d", "t", k=60).collect()}
    assert few.count() and all(r.d < 5 and full[r.qid, r.d] == r.score for r in few.collect())
    assert lexical.bm25(docs.limit(0), asked, "d", "t").count() == 0 and lexical.bm25(docs, asked.limit(0), "d", "t").count() == 0


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([("a", 0, 5)], "chunk_id string, byte_start int, byte_end int")
    new = spark.createDataFrame([("a", 9, 9), ("b", 3, 4), ("b", 1, 2)], "chunk_id string, byte_start int, byte_end int")
    assert {tuple(r) for r in store.add_chunks(old, new).collect()} == {("a", 0, 5), ("b", 1, 2)}
    e = spark.createDataFrame([("x", "y", "CALLS")] * 2, "src string, dst string, kind string")
    assert store.add_edges(e.limit(1), e).count() == 1
    s = spark.createDataFrame([("n", "q.py", 3, "s"), ("n", "p.py", 9, "t")], "node_id string, path string, byte_start int, symbol string")
    assert store.add_symbols(s.limit(0), s).first().path == "p.py"
    files = spark.createDataFrame([("r1", "p", "h1"), ("r2", "p", "h2")], "ref string, path string, blob_hash string")
    put = spark.createDataFrame([("r2", "q", "h4"), ("r2", "q", "h3")], "ref string, path string, blob_hash string")
    assert {tuple(r) for r in store.map_files(files, put).collect()} == {("r1", "p", "h1"), ("r2", "q", "h3")}
    kinds = "chunk_id string, model string, dim int, vector array<float>"
    have = spark.createDataFrame([("a", "m", 2, [1.0, 0.0]), ("b", "m", 2, [0.0, 1.0])], kinds)
    more = spark.createDataFrame([("b", "m", 2, [0.5, 0.5]), ("c", "k", 3, [1.0, 2.0, 3.0])], kinds)
    assert {(r.chunk_id, r.model, r.dim, r.vector[0]) for r in store.put_vectors(have, more).collect()} == {("a", "m", 2, 1.0), ("b", "m", 2, 0.5), ("c", "k", 3, 1.0)}
    with pytest.raises(Exception, match="another dim"):
        store.put_vectors(have, spark.createDataFrame([("z", "m", 3, [1.0, 2.0, 3.0])], kinds)).collect()
    assert store.compatible(have.withColumn("tag", F.lit("v1")), "tag", "v2").count() == 0


def test_table_folder(spark, tmp_path):
    folder = store.TableFolder(spark, "file://" + str(tmp_path / "ix"))
    assert folder.table("t", "a int").count() == 0 and folder.meta("m") is None
    assert folder.write({"t": spark.range(3).selectExpr("cast(id as int) a")}, {"m": 1}) == 1
    assert folder.write({"t": folder.table("t", "a int").where("a > 0")}, {"n": "x"}) == 2
    assert folder.table("t", "a int").count() == 2 and folder.meta("m") == 1 and folder.meta("n") == "x"
    stale = store.TableFolder(spark, folder.folder)
    stale.state = lambda: {"number": 1, "tables": {}, "meta": {}}
    with pytest.raises(RuntimeError, match="another writer"):
        stale.write({}, {"m": 9})
    assert folder.vacuum() >= 2 and folder.table("t", "a int").count() == 2 and folder.meta("m") == 1


def test_chunks_by_id_and_usage(spark):
    c = spark.createDataFrame([("a", "b1", 0, 3), ("a", "b1", 0, 3)], "chunk_id string, blob_hash string, byte_start int, byte_end int")
    got = store.get_chunks(c, spark.createDataFrame([(1, "a"), (2, "nope")], "qid int, chunk_id string"))
    assert {(r.qid, r.found, r.byte_end) for r in got.collect()} == {(1, True, 3), (2, False, None)}
    u = spark.createDataFrame([(True,), (False,), (False,), (None,)], "expanded boolean")
    assert usage.expand_rate(u).first().expand_rate == pytest.approx(1 / 3) and usage.expand_rate(u.limit(0)).first().expand_rate == 0.0
    assert rerank.SMALL_INDEX == 512
