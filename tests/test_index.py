"""Index operators on small hand-made inputs."""

import math
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tessera.functions import text
from tessera.operators import chunking, evalkit, fusion, graph, ingest, lexical, packing, symbols, usage, vectors


def test_rrf_by_hand(spark):
    ls = lambda xs: spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(xs)], "qid int, k string, rank int")
    got = {r.k: r.score for r in fusion.rrf([ls("abc"), ls("bda")], "k").collect()}
    assert got == {"a": round(1 / 61 + 1 / 63, 9), "b": round(1 / 62 + 1 / 61, 9), "c": round(1 / 63, 9), "d": round(1 / 62, 9)}
    dup = {r.k: r.score for r in fusion.rrf([ls("aab")], "k").collect()}
    assert dup["b"] == round(1 / 63, 9)  # the second a still used up rank 2
    with pytest.raises(ValueError):
        fusion.rrf([ls("a")], "k", k=0)
    with pytest.raises(ValueError):
        fusion.rrf([ls("a")], "k", weights=[1, 2])


def plain_pack(items, budget):
    kept, total = [], 0
    for x in sorted(items, key=lambda x: (-(x[6] / max(1, x[7])), -x[6], x[1])):
        cost = max(1, x[7])
        if total + cost > budget or (x[5] and any(y[5] == x[5] for y in kept)):
            continue
        if any(y[2] == x[2] and y[3] < x[4] and x[3] < y[4] for y in kept):
            continue
        kept.append(x)
        total += cost
    return [x[1] for x in sorted(kept, key=lambda x: (-x[6], x[1]))]


PACK = "qid int, chunk_id string, blob_hash string, byte_start int, byte_end int, breadcrumb string, score double, tokens int"


def test_packing_equals_a_loop(spark):
    import random

    r = random.Random(5)
    items = []
    for q in range(40):
        for c in range(r.randint(0, 12)):
            a = r.randint(0, 50)
            items.append((q, f"c{c}", r.choice("xy"), a, a + r.randint(1, 20), r.choice(["", "s", "t", None]), r.randint(1, 9) / 4, r.randint(0, 30)))
    got = {}
    for x in packing.pack(spark.createDataFrame(items, PACK), 60).orderBy("qid", "place").collect():
        got.setdefault(x.qid, []).append(x.chunk_id)
    for q in range(40):
        assert got.get(q, []) == plain_pack([x for x in items if x[0] == q], 60)
    assert packing.pack(spark.createDataFrame([], PACK), 60).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], PACK), -1)


def plain_windows(t, window, overlap, cap):
    data = t.encode()
    lines = data.split(b"\n")
    ends, at = [], 0
    for k, x in enumerate(lines):
        at = min(len(data), at + len(x) + 1)
        if k < len(lines) - 1 or x:
            ends.append(at)
    out, s, step = [], 0, window - overlap
    while ends:
        e = min(s + window, len(ends))
        a, b = (ends[s - 1] if s else 0), ends[e - 1]
        out += [(x, min(x + cap, b)) for x in range(a, b, cap)]
        if e == len(ends):
            break
        s += step
    return out


def test_line_windows(spark):
    texts = ["", None, "a", "a\n", "a\nb", "\n\n\n", "é\n" * 121, "x\n" * 120, "y\n" * 121, "z" * 40000, "q\r\n" * 7, "long" * 99 + "\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for window, overlap, cap in ((120, 20, 16384), (20, 5, 16384), (7, 2, 300)):
        got = {}
        for r in chunking.line_windows(df, "i", "t", window, overlap, cap).orderBy("i", "byte_start", "byte_end").collect():
            got.setdefault(r.i, []).append((r.byte_start, r.byte_end))
        for i, t in enumerate(texts):
            assert got.get(i, []) == sorted(plain_windows(t, window, overlap, cap) if t else []), (i, window)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc {}()[]\n\té:=def", max_size=600), st.sampled_from(["python", "go", "text"]))
def test_structural_pieces_partition_any_text(t, language):
    data = t.encode()
    got = chunking.structural_pieces(data, language, 40)
    assert b"".join(data[a:b] for a, b in got) == data
    for a, b in got:
        data[a:b].decode()
        assert chunking._inked(data, a, b) <= 43


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc {}()[]\n\té:=def", min_size=1, max_size=600), st.sampled_from(["python", "go", "text"]))
def test_structural_pieces_cover_every_text(t, language):
    got = chunking.structural_pieces(t.encode(), language, 40)
    assert got and b"".join(t.encode()[a:b] for a, b in got) == t.encode()


def test_python_that_does_not_parse_keeps_what_does():
    good = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(4))
    code = (good + "def bad(:\n    x\n\n" + good).encode()
    got = chunking.pieces(code, "python", 60)
    assert b"".join(code[a:b] for a, b, _ in got) == code
    assert [code[a : a + 7] for a, b, bad in got if bad] == [b"def bad"]  # alone, merged with nothing
    crumbs = chunking.breadcrumbs(code, "python", "p/a.py", got)
    assert [c for c in crumbs if c.endswith("does not parse")] == ["# p/a.py :: bad :: def bad(: :: does not parse"]
    # mostly errors, or no whole definition: windows of lines, all of them marked
    for text in (b"def f(:\n  pass\n", b"<<<<<<< a\nx = 1\n=======\n>>>>>>> b\n"):
        assert [t for _, _, t in chunking.pieces(text, "python")] == [True]


def test_large_definitions_are_split_level_by_level():
    method = lambda i: f"    def m{i}(self):\n        \"\"\"Doc {i}.\"\"\"\n        return {'1 + ' * 60}{i}\n\n"
    code = ("class A:\n    x = 1\n\n" + "".join(map(method, range(4))) + "def last():\n    pass\n").encode()
    got = chunking.pieces(code, "python", 200)
    assert b"".join(code[a:b] for a, b, _ in got) == code
    assert [code[a:b].split(b"(")[0].split()[-1] for a, b, _ in got] == [b"m0", b"m1", b"m2", b"m3"]
    assert chunking.breadcrumbs(code, "python", "a.py", got)[1] == "# a.py :: A > m1 :: def m1(self): :: Doc 1."
    go = b"package a\n\nfunc (b *Box) Put() {\n" + b"\tx()\n" * 50 + b"}\n\nfunc New() {\n" + b"\ty()\n" * 50 + b"}\n"
    assert [go[a : a + 8] for a, _, _ in chunking.pieces(go, "go", 250)] == [b"package ", b"func New"]
    deep = ("def f():\n" + "".join("    " * (i + 1) + f"def g{i}():\n" for i in range(60)) + "    " * 61 + "pass\n").encode()
    assert b"".join(deep[a:b] for a, b, _ in chunking.pieces(deep, "python", 30)) == deep


def test_structural_cuts_at_declarations():
    code = "import os\n\n" + "".join(f"def f{i}():\n    return {i} + {'1 + ' * 200}0\n\n" for i in range(3))
    got = chunking.structural_pieces(code.encode(), "python", 700)
    # the import and the first function fit together, two functions don't
    assert [code.encode()[a : a + 6] for a, _ in got] == [b"import", b"def f1", b"def f2"]


def test_structural_chunks_of_whole_blobs(spark, tmp_path):
    """A statement that goes on in the next chunk is not cut there, and no chunk but the first is left out."""
    from tessera.plans import index_queries

    code = "".join(f"def f{i}():\n    return {i} + {'1 + ' * 200}0\n\n" for i in range(9)) + "x = 'é'\n"
    data = code.encode()
    cut = lambda blob, size, step, lang="python": [(blob, a, a + len(data[a : a + size]), lang, data[a : a + size].decode("utf-8", "ignore"), f"{blob}:{a}", "p/a.py") for a in range(0, len(data), step)]
    rows_ = cut("a", 500, 500) + cut("B", 700, 500) * 2 + [("gap", 0, 6, None, "x = 1\n", "g0", "g.txt"), ("gap", 50, 56, None, "y = 2\n", "g5", "g.txt"), ("late", 9, 15, "go", "z := 3", "l9", "l.go"), ("nul", 0, 3, "go", None, "n0", "n.go"), ("", 0, 0, "go", "", "e0", "e.go")]
    spark.createDataFrame(rows_, "blob_hash string, byte_start int, byte_end int, language string, code string, chunk_id string, file_path string").write.parquet(str(tmp_path / "chunks.parquet"))
    got: dict = {}
    for r in index_queries.chunk_structural(spark, str(tmp_path)).orderBy("blob_hash", "byte_start").collect():
        got.setdefault(r.blob_hash, []).append((r.byte_start, r.byte_end))
    want = chunking.structural_pieces(data, "python")
    assert got == {"a": want, "b": want, "gap": [(0, 6), (50, 56)], "late": [(9, 15)]} and len(want) > 2


def test_bm25_by_formula(spark):
    docs = spark.createDataFrame([(1, "the cat cat"), (2, "the dog"), (3, "Naïve cat"), (4, None), (5, "")], "id int, t string")
    q = spark.createDataFrame([(1, "cat"), (2, "cat cat"), (3, "naive"), (4, "?!"), (5, None), (6, "unknown")], "qid int, query string")
    got = {(r.qid, r.id): r.score for r in lexical.bm25(docs, q, "id", "t").collect()}
    n, avg = 5, 7 / 5
    idf = lambda df: max(math.log((n - df + 0.5) / (df + 0.5)), 0) or 1e-6
    s = lambda df, tf, dl: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    want = {(1, 1): s(2, 2, 3), (1, 3): s(2, 1, 2), (2, 1): 2 * s(2, 2, 3), (2, 3): 2 * s(2, 1, 2), (3, 3): s(1, 1, 2)}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    assert lexical.bm25(docs.limit(0), q, "id", "t").count() == 0 and lexical.bm25(docs, q.limit(0), "id", "t").count() == 0


def test_items_ask_with_their_whole_text(spark, tmp_path):
    """A chunk that shares only words after the first eight of an item is found."""
    from tessera.plans import index_queries

    chunks = [(f"c{i}", f"b{i}", 0, 9, f"p/{i}.py", "python", code, f"crumb {i}") for i, code in enumerate(["def late(): return harbor", "def other(): late()", "def first(): return one", "pass", "pass", "pass"])]
    spark.createDataFrame(chunks, "chunk_id string, blob_hash string, byte_start int, byte_end int, file_path string, language string, code string, breadcrumb string").write.parquet(str(tmp_path / "chunks.parquet"))
    items = [(1, "one two three four five six seven eight nine harbor"), (2, "a b c d e f g h harbor"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    spark.createDataFrame([(f"b{i}", True) for i in range(6)], "blob_hash string, active boolean").write.parquet(str(tmp_path / "blobs.parquet"))
    for name in ("search_packed", "search_reranked"):
        assert {(r.qid, r.chunk_id) for r in index_queries.QUERIES[name](spark, str(tmp_path)).collect()} == {(1, "c0"), (1, "c2"), (2, "c0")}, name
    # what calls the chunk found is one hop from it
    assert {(r.qid, r.chunk_id) for r in index_queries.search_expanded(spark, str(tmp_path)).collect()} == {(1, "c1"), (2, "c1")}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [6.0, 8.0])], "id int, v array<float>")
    unit = {r.id: r.u for r in v.where("v is not null").select("id", vectors.normalised(F.col("v")).alias("u")).collect()}
    assert unit[1] == [0.6000000000000001, 0.8] or unit[1] == [0.6, 0.8]
    assert unit[2] == [0.0, 0.0]
    got = vectors.top_k(v, v.select(F.col("id").alias("qid"), "v"), "id", "v", k=2)
    by = {}
    for r in got.orderBy("qid", "rank").collect():
        by.setdefault(r.qid, []).append((r.id, r.score))
    assert by[1] == [(5, 50.0), (1, 25.0)] and by[4] == [(4, 1.0)] and 3 not in by and by[2] == [(1, 0.0), (2, 0.0)]
    made = vectors.embed(
        spark.createDataFrame([("a", "x", "y"), ("b", "x", "y"), ("c", None, None)], "chunk_id string, breadcrumb string, code string"),
        spark.createDataFrame([("c",)], "chunk_id string"), lambda ts: [[float(len(t)), 0.0] for t in ts],
    )
    assert {r.chunk_id: r.vector for r in made.collect()} == {"a": [1.0, 0.0], "b": [1.0, 0.0]}


def test_query_functions(spark):
    q = spark.createDataFrame([("where does fetchWithRetry call my_func or Flush( and x2y in pkg/a.go?",), ("slugify",), ("connect to the",), ("(*Archive).Write",), (None,)], "q string")
    got = [r.t for r in q.select(text.identifier_tokens(F.col("q")).alias("t")).collect()]
    assert got == [["fetchWithRetry", "my_func", "Flush", "x2y"], ["slugify"], [], ["Archive", "Write"], None]
    segs = [r.t for r in q.select(text.path_segments(F.col("q")).alias("t")).collect()]
    assert segs[0] == ["pkg/a.go"] and segs[1] == []
    odd = spark.createDataFrame([("see https://h.x/a/b. or ./c/d.py, x.y.ts, z.go-like, a.md, 9abc A1Bc",)], "q string")
    assert odd.select(text.path_segments(F.col("q"))).first()[0] == ["h.x/a/b", "./c/d.py", "y.ts", "z.go"]
    assert odd.select(text.split_identifier(F.lit("A1Bc2DE"))).first()[0] == ["a", "1", "bc2", "de"]
    assert odd.select(text.query_terms(F.lit("getUserName of x_id 9abc"))).first()[0] == ["abc", "get", "getusername", "name", "user", "x_id"]
    assert odd.select(text.search_tokens(F.lit("Ǎé Ṩe\u0301 ÀB_c"))).first()[0] == ["ae", "se", "ab_c"]
    words = spark.createDataFrame([("fetchHTTPResponse_v2",), ("ABC",), ("",)], "w string").select(text.split_identifier(F.col("w")).alias("t"))
    # an upper-case run that a lower-case letter follows gives up its last letter
    assert [r.t for r in words.collect()] == [["fetch", "http", "response", "v2"], ["abc"], []]
    est = spark.createDataFrame([("",), ("abcd",), ("a\n" * 8,)], "c string").select(text.retrieval_tokens(F.col("c")), text.tool_tokens(F.col("c")))
    assert [tuple(r) for r in est.collect()] == [(1, 1), (1, 1), (6, 4)]


def test_ingest_rules(spark):
    p = ["a/node_modules/x.js", "node_modules", "go.sum", "a/b.min.js", "src/a.py", "docs/x.md", "A.PY", "x.tar.gz", "keep/me.txt"]
    df = spark.createDataFrame([(x, 10) for x in p] + [("big.py", 3_000_000), ("none.py", None)], "path string, size int")
    hit = {r.path for r in df.where(ingest.is_skipped(F.col("path"), F.col("size"), ingest.matches_ignore(F.col("path"), ["docs/", "*.gz", "", "# x"]))).collect()}
    assert hit == {"a/node_modules/x.js", "go.sum", "a/b.min.js", "docs/x.md", "x.tar.gz", "big.py"}
    lang = dict(df.select("path", ingest.language_of(F.col("path"))).collect())
    assert lang["A.PY"] == "python" and lang["x.tar.gz"] == "text" and lang["node_modules"] == "text"
    blob = spark.createDataFrame([(b"hello\n",), (b"",)], "b binary").select(ingest.blob_hash(F.col("b")))
    assert [r[0] for r in blob.collect()] == ["ce013625030ba8dba906f756967f9e9ca394464a", "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"]
    nul = spark.createDataFrame([(b"a\0b",), (b"x" * 8192 + b"\0",), (b"\x10\x01",)], "b binary").select(ingest.is_binary(F.col("b")))
    assert [r[0] for r in nul.collect()] == [True, False, False]
    known = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("c", False), (None, True)], "blob_hash string, active boolean")
    want = spark.createDataFrame([("a",), ("b",), ("d",), (None,)], "blob_hash string")
    assert rows(ingest.activation(known, want)) == [("deactivate", "c"), ("index", "d"), ("reactivate", "b")]


def world(spark):
    """Four chunks: two callers of one function, which calls a fourth."""
    c = [
        ("a1", "A", 0, 50, "p/a.py", "python", "def alpha():\n    beta()\n"),
        ("b1", "B", 0, 40, "p/b.py", "python", "def beta():\n    delta()\n"),
        ("c1", "C", 0, 40, "q/c.py", "python", "def gamma():\n    beta()\n    get()\n"),
        ("d1", "D", 0, 40, "q/d.py", "python", "def delta():\n    pass\ndef get():\n    pass\n"),
    ]
    return spark.createDataFrame(c, "chunk_id string, blob_hash string, byte_start int, byte_end int, file_path string, language string, code string")


def test_graph(spark):
    chunks = world(spark)
    defs, sites = symbols.definitions(chunks), symbols.calls(chunks)
    edges = graph.call_edges(defs, sites)
    assert rows(edges.select("src", "dst")) == [("b1", "a1"), ("b1", "c1"), ("d1", "b1")]  # (dst, src); get is generic
    names = spark.createDataFrame([(1, "beta")], "qid int, name string")
    got = graph.callers(defs, edges, chunks, names).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("a1", 1.0), ("c1", 0.97)]  # the same package first
    near = graph.neighbours(edges, spark.createDataFrame([("b1",)], "node string"))
    assert {(r.neighbour, r.relation) for r in near.collect()} == {("a1", "caller"), ("c1", "caller"), ("d1", "callee")}
    top = spark.createDataFrame([(1, "b1", 1.0, 1), (1, "a1", 0.5, 2)], "qid int, chunk_id string, score double, rank int")
    assert {(r.chunk_id, r.score, r.parent) for r in graph.expand(top, edges).collect()} == {("c1", 0.6, "b1"), ("d1", 0.6, "b1")}
    found = symbols.symbol_search(defs, spark.createDataFrame([(1, "ETA"), (2, "alpha"), (3, "")], "qid int, name string"))
    assert [(r.qid, r.symbol) for r in found.orderBy("qid", "rank").collect()] == [(1, "beta"), (2, "alpha")]


def test_router_boundary(spark):
    many = lambda n, name: [(name, "function", "B", f"{name}{i}", f"p{i}/f.py", 0) for i in range(n)]
    syms = spark.createDataFrame(many(8, "do_it") + many(9, "run_it") + many(1, "only_one"), "symbol string, kind string, blob_hash string, chunk_id string, path string, byte_start int")
    q = spark.createDataFrame([(1, "run_it do_it only_one in p5/f.py"), (2, "plain words")], "qid int, query string")
    got = symbols.route(syms, q).orderBy(F.desc("score"), "chunk_id").collect()
    assert [r.token for r in got if r.score in (1.0, 0.88, 0.76)] == ["only_one", "do_it", "run_it"]  # 9 definitions are ambiguous
    assert {r.chunk_id for r in got if r.token == "do_it"} == {"do_it5", "do_it0", "do_it1"} and not [r for r in got if r.qid == 2]


def test_overlap(spark):
    ch = spark.createDataFrame([("B", "x", 0, 100), ("B", "y", 50, 160), ("B", "z", 100, 130)], "blob_hash string, chunk_id string, byte_start int, byte_end int")
    sp = spark.createDataFrame([(1, "B", 105, 125), (2, "B", 90, 110), (3, "B", 500, 600), (4, "Q", 0, 9)], "span_id int, blob_hash string, byte_start int, byte_end int")
    assert rows(graph.best_overlap(sp, ch).select("span_id", "chunk_id")) == [("y", 1), ("y", 2)]
    assert rows(graph.smallest_container(sp, ch)) == [("y", 2), ("z", 1)]


def test_symbol_changes(spark):
    s = "symbol string, kind string, text string, byte_start int"
    old = spark.createDataFrame([("a", "f", "1", 0), ("a", "f", "2", 5), ("b", "f", "x", 0)], s)
    new = spark.createDataFrame([("a", "f", "2", 0), ("c", "f", "x", 0)], s)
    assert rows(graph.symbol_changes(old, new)) == [("added", "f", "c"), ("removed", "f", "b")]


def test_percentiles(spark):
    for n in (1, 2, 19, 20, 21, 100):
        v = spark.createDataFrame([("t", float(i)) for i in range(n)], "tool string, x double")
        for pick, want in ((usage.p95_usage, min(n - 1, int(0.95 * n))), (usage.p95_eval, max(0, int(0.95 * n) - 1)), (usage.p95_support, min(n - 1, int(0.95 * (n - 1) + 0.999))), (usage.p95_bench, max(1, min(n, round(0.95 * n + 0.5))) - 1)):
            assert usage.percentile_at(v, ["tool"], "x", pick).first().x == want, (n, pick)


def test_quality_and_gate(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 6)], "qid int, k string, rank int")
    gold = spark.createDataFrame([(1, "nl", "b"), (2, "nl", "c"), (3, "nl", "z")], "qid int, type string, k string")
    r = evalkit.quality(ranked, gold, "k").first()
    assert (r.n, r.recall, r.mrr, r.mrr_at_k) == (3, round(1 / 3, 6), round((0.5 + 1 / 6) / 3, 6), round(0.5 / 3, 6))
    assert evalkit.passes_gate(0.9, 0.7, [0.8, 0.7]) and not evalkit.passes_gate(0.9, 0.7, [0.9])


def test_git_source(spark, tmp_path):
    from tessera.sources.git import GitSource, NotARepository

    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    spark.dataSource.register(GitSource)
    read = lambda **o: spark.read.format("gitrepo").options(path=str(repo), **o).load()
    assert read().count() == 0
    (repo / "a b.py").write_text("x = 1\n")
    (repo / "d").mkdir()
    (repo / "d" / "ü.bin").write_bytes(b"\0\1")
    run("add", "-A")
    run("commit", "-qm", "one")
    (repo / "a b.py").unlink()
    (repo / "c.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "two")
    assert {r.path for r in read().collect()} == {"c.py", "d/ü.bin"}
    data = {r.path: (r.blob_hash, bytes(r.content)) for r in read(mode="blobs", rev="HEAD~1").collect()}
    assert data["a b.py"][1] == b"x = 1\n" and data["d/ü.bin"][1] == b"\0\1"
    ours = read(mode="blobs").select("blob_hash", ingest.blob_hash(F.col("content")).alias("h"))
    assert ours.where("blob_hash <> h").count() == 0
    log = read(mode="log").orderBy("ordinal").collect()
    assert [r.message for r in log] == ["one", "two"] and {(f.status, f.path) for f in log[1].files} == {("D", "a b.py"), ("A", "c.py")}
    with pytest.raises(Exception, match="no git repository|NotARepository"):
        spark.read.format("gitrepo").options(path=str(tmp_path)).load().count()
    assert NotARepository.__mro__[1] is ValueError
    stream = spark.readStream.format("gitrepo").options(path=str(repo), mode="log").load()
    q = stream.writeStream.format("memory").queryName("gitlog").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("gitlog").count() == 2
    first = log[0].sha
    assert [r.message for r in read(mode="log", since=first).collect()] == ["two"]
    assert read(mode="log", since="1990-01-01").count() == 2 and read(mode="log", since="2090-01-01").count() == 0
    with pytest.raises(Exception, match="rev-parse|failed"):
        read(mode="log", since="no-such-ref").count()
    assert [r.path for r in read(mode="sources").collect()] == ["c.py"]
    from tessera.sources.git import GitLogStream, head

    reader = GitLogStream({"path": str(repo)})
    end = reader.latestOffset()
    assert end == {"commit": head(str(repo))} and reader.initialOffset() == {"commit": ""}
    rows_of = lambda a, b: sorted(x[4] for part in reader.partitions(a, b) for x in reader.read(part))
    assert rows_of({"commit": ""}, end) == ["one", "two"] and rows_of({"commit": first}, end) == ["two"] and rows_of(end, end) == []
    run("commit", "-q", "--amend", "-m", "two again")  # history is rewritten: what the old name does not reach comes
    assert rows_of(end, reader.latestOffset()) == ["two again"]


def test_gold_and_query_files(spark, tmp_path):
    from tessera.sources import queryfiles

    (tmp_path / "q.txt").write_text("one\n\n  two \n")
    assert [r.query for r in queryfiles.query_file(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]
    (tmp_path / "g.jsonl").write_text("".join('{"id": "%d", "type": "nl", "query": "q", "expected_files": ["f"]}\n' % i for i in range(19)))
    with pytest.raises(ValueError):
        queryfiles.gold_set(spark, str(tmp_path / "g.jsonl"))


def test_usage_stream_equals_batch(spark, tmp_path):
    from tessera.streaming import usage_stream

    src = tmp_path / "in"
    df = spark.createDataFrame([(f"2025-01-0{1 + i % 3} 0{i % 9}:00:00", "ab"[i % 2], i, i % 4) for i in range(40)], "t string, tool string, tokens long, user_id long").select(F.to_timestamp("t").alias("ts"), "tool", "tokens", "user_id")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    usage_stream.write_available(usage_stream.windowed_calls(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    # the watermark holds back the last day; what came out is the batch result of closed windows
    batch = {(str(r.d), r.tool): r.n for r in df.groupBy(F.to_date("ts").alias("d"), "tool").agg(F.count("*").alias("n")).collect()}
    assert got.count() > 0 and all(batch[str(r.start)[:10], r.tool] == r.calls for r in got.collect())


def test_incremental_sync_equals_rebuild(spark, tmp_path):
    import random

    from tessera.streaming.sync_stream import IndexFolder

    r, schema = random.Random(3), "path string, blob_hash string, size_bytes long"
    index = IndexFolder(spark, "file://" + str(tmp_path / "index"))
    ever, tree = {}, {}
    for step in range(4):
        for _ in range(5):
            tree[f"f{r.randint(0, 7)}.py"] = f"h{r.randint(0, 9)}"
        if len(tree) > 3:
            tree.pop(sorted(tree)[0])
        df = spark.createDataFrame([(p, h, 10) for p, h in tree.items()] + [("node_modules/x.js", "skip", 1)], schema)
        index.sync(df, step)
        if step == 2:
            index.sync(df, step)  # a repeated batch changes nothing
        ever.update(dict.fromkeys(tree.values()))
    got = {x.blob_hash: x.active for x in index.state().collect()}
    assert got == {h: h in tree.values() for h in ever}


def test_a_tree_in_two_batches_is_taken_in_whole(spark, tmp_path):
    from tessera.streaming.sync_stream import IndexFolder, sync_stream

    schema = "tree_id int, n_files int, path string, blob_hash string, size_bytes long"
    source, index = tmp_path / "trees", IndexFolder(spark, "file://" + str(tmp_path / "index"))

    def deliver(name, data, checkpoint="cp"):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        sync_stream(stream, index, str(tmp_path / checkpoint)).awaitTermination()
        return {r.blob_hash: r.active for r in index.state().collect()}

    assert deliver("a", [(1, 3, "a.py", "h1", 1), (1, 3, "b.py", "h2", 1)]) == {}
    assert deliver("b", [(1, 3, "c.py", "h3", 1)]) == {"h1": True, "h2": True, "h3": True}
    assert deliver("c", [(4, 2, "a.py", "h1", 1)]) == {"h1": True, "h2": True, "h3": True}
    want = {"h1": True, "h2": False, "h3": False, "h4": True}
    assert deliver("d", [(4, 2, "d.py", "h4", 1)]) == want
    assert deliver("e", [(2, 1, "z.py", "old", 1)], "lost") == want  # without its checkpoint the stream begins anew


def line_words(line):
    import re

    names = re.findall(r"[A-Za-z_]\w+", line)
    return {x.lower() for n in names for x in [n, *re.findall("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", n)]}


def plain_focus(terms, label, code, most):
    """Every window tried from every line."""
    room = max(0, most - len(label) - 1)
    if len(code) <= room or not room:
        return f"{label}\n{code[:room]}"
    lines, best = code.splitlines(keepends=True), None
    for a in range(len(lines)):
        b = a
        while b < len(lines) and sum(map(len, lines[a : b + 1])) <= room:
            b += 1
        got = set().union(*(line_words(x) & terms for x in lines[a : max(b, a + 1)]))
        if best is None or len(got) > best[0]:
            best = len(got), "".join(lines[a:b]) or lines[a][:room]
    return f"{label}\n{best[1]}"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["alpha beta\n", "getUserName()\n", "\n", "x = 1\r\n", "gamma_delta " * 4 + "\n", "user"]), max_size=14), st.integers(0, 60))
def test_focus_equals_trying_all_windows(lines, most):
    from tessera.operators import rerank

    terms = {"alpha", "user", "gamma", "delta"}
    code = "".join(lines)
    got = rerank.focus(sorted(terms), "lb", code, [sorted(line_words(x)) for x in code.split("\n")], most)
    assert got == plain_focus(terms, "lb", code, most)


def test_rerank_blend_and_trim(spark):
    from tessera.operators import rerank

    pool = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid int, chunk_id string, place int")
    q = spark.createDataFrame([(1, "find user")], "qid int, query string")
    ch = spark.createDataFrame([("a", "x", "none"), ("b", None, "user here"), ("c", "y", None)], "chunk_id string, breadcrumb string, code string")
    done = rerank.rerank(rerank.passages(pool, q, ch), lambda ps: [2.0 if "user" in p else -800.0 for _, p in ps])
    got = {r.chunk_id: (r.rank, r.score) for r in done.collect()}
    assert [got[c][0] for c in "bac"] == [1, 2, 3] and got["a"][1] == 0.0 and abs(got["b"][1] - 1 / (1 + math.exp(-2))) < 1e-8
    vec = spark.createDataFrame([(1, "c", 1), (1, "z", 2), (1, "a", 3)], "qid int, chunk_id string, rank int")
    small = {r.chunk_id: r.score for r in rerank.blend(done, vec, spark.range(600).selectExpr("cast(id as string) blob_hash", "id < 512 active")).collect()}
    assert small == {"a": round(1 / 62 + 4 / 63, 9), "b": round(1 / 61, 9), "c": round(1 / 63 + 4 / 61, 9)}
    rows_ = spark.createDataFrame([(1, 1, 40), (1, 2, 40), (1, 3, 40)], "qid int, place int, row_chars int")
    assert rows(rerank.trim_replies(rows_, 20)) == [(1, 1, 40, 1), (2, 1, 40, 1)]
    with pytest.raises(Exception, match="another number"):
        rerank.rerank(rerank.passages(pool, q, ch), lambda ps: [0.0] * (len(ps) + 1)).collect()


def test_related_order(spark):
    from tessera.operators import rerank

    pairs = spark.createDataFrame([(1, "n1", "p/a.py", 0, "p/t.py", 0), (1, "n2", "p/t.py", 5, "p/t.py", 1), (1, "n3", "q/b.py", 0, "p/t.py", 2), (1, "n3", "q/b.py", 0, "q/b.py", 3)], "qid int, node string, path string, byte_start int, target_path string, at int")
    got = rerank.rank_related(pairs, spark.createDataFrame([("n3", 500)], "node string, n long"), spark.createDataFrame([("q/b.py", "2009-12-29 00:00:00")], "path string, d string").selectExpr("path", "cast(d as timestamp) at_date"))
    assert [(r.node, r.score) for r in got.orderBy("rank").collect()] == [("n2", 2000.0), ("n1", 1000.0), ("n3", 990.1)]
