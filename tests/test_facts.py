"""Facts, import targets and edges on a small collection in five languages, worked out by hand."""

from tests.conftest import rows
from tessera.operators import facts, resolve

CODE = {
    "app/main.py": "import os\nfrom app.store import Store, LIMIT\nfrom . import tools\nfrom .tools import helper\n\nDEBUG = True\n\n\ndef run(s: Store):\n    t = Store()\n    t.save(1)\n    s.load()\n    helper()\n    unknown()\n    get()\n\n\nclass App(Store):\n    def go(self):\n        self.stop()\n        run(self)\n\n    def stop(self):\n        pass\n",
    "app/store.py": "LIMIT = 3\n\n\nclass Store:\n    def save(self, x):\n        return x\n\n    def load(self):\n        return lonely()\n",
    "app/tools.py": "def helper():\n    return 1\n\n\ndef get():\n    pass\n",
    "lib/other.py": "def helper():\n    return 2\n\n\ndef lonely():\n    pass\n",
    "web/api.ts": "import { send } from './net';\nimport * as u from '../web/util/index';\nexport interface Shape { a: number }\nexport class Api {\n  call(x: Shape): void {\n    const c = new Client();\n    c.open();\n    send(x);\n    lonely();\n  }\n}\nexport class Client {\n  open() { return 1; }\n}\n",
    "web/net.ts": "export function send(x) {\n  return open(x);\n}\nexport const MOST = 3;\n",
    "web/util/index.ts": "export const twice = (x) => x * 2;\n",
    "srv/pkg/box/box.go": "package box\n\ntype Box struct {\n\tn int\n}\n\nfunc (b *Box) Put(x int) {\n\tb.fill(x)\n}\n\nfunc (b *Box) fill(x int) {\n}\n\nfunc New() *Box {\n\treturn &Box{}\n}\n",
    "srv/main.go": "package main\n\nimport (\n\t\"example.com/x/pkg/box\"\n)\n\nfunc main() {\n\tb := box.New()\n\tb.Put(1)\n}\n",
    "api/v1/a.proto": 'syntax = "proto3";\nimport "v1/b.proto";\nmessage A {\n  B b = 1;\n}\nservice S {\n  rpc F (A) returns (B);\n}\n',
    "api/v1/b.proto": 'syntax = "proto3";\nmessage B {\n  string x = 1;\n}\n',
    "broken.py": "def early():\n    late(\n\ndef after(x):\n    early()\n",
}
LANGUAGE = {"py": "python", "ts": "typescript", "go": "go", "proto": "proto"}
CHUNKS = "blob_hash string, byte_start int, language string, code string, file_path string, repo string"


def collection(spark):
    data = []
    for path, text in CODE.items():
        raw, lang = text.encode(), LANGUAGE[path.rsplit(".", 1)[1]]
        data += [(path.upper(), a, lang, raw[a : a + 50].decode(), path, "r") for a in range(0, len(raw), 50)]
    data += [data[0], ("T", 0, "text", "def no(): pass", "t.md", "r"), (None, 0, "go", "x", "n", "r"), ("N", 0, "go", None, "n", "r")]
    chunks = spark.createDataFrame(data, CHUNKS)
    files = spark.createDataFrame([("r", p, p.lower()) for p in CODE], "repo string, path string, blob_hash string")
    return chunks, files


def test_graph_of_five_languages(spark):
    chunks, files = collection(spark)
    found = facts.file_facts(chunks).cache()
    nodes = resolve.symbols(found, files).cache()
    name = {n.node_id: n.path + ":" + n.symbol if n.kind != "module" else n.path for n in nodes.collect()}
    kinds = {(n.path, n.symbol): n.kind for n in nodes.collect()}
    assert kinds["app/main.py", "go"] == "method" and kinds["app/main.py", "run"] == "function" and kinds["app/store.py", "LIMIT"] == "const"
    assert kinds["web/api.ts", "call"] == "method" and kinds["web/api.ts", "Shape"] == "interface" and kinds["web/util/index.ts", "twice"] == "function"
    assert kinds["srv/pkg/box/box.go", "Put"] == "method" and kinds["api/v1/a.proto", "F"] == "method" and kinds["broken.py", "after"] == "function"
    spans = {(n.path, n.symbol): (n.byte_start, n.byte_end) for n in nodes.collect()}
    a, b = spans["web/net.ts", "send"]
    assert CODE["web/net.ts"][a:b] == "export function send(x) {\n  return open(x);\n}"
    assert {(i.path, i.module, i.target) for i in resolve.import_targets(found, files).collect()} == {
        ("app/main.py", "app.store", "app/store.py"), ("app/main.py", ".", "app/tools.py"), ("app/main.py", ".tools", "app/tools.py"),
        ("web/api.ts", "./net", "web/net.ts"), ("web/api.ts", "../web/util/index", "web/util/index.ts"),
        ("srv/main.go", "example.com/x/pkg/box", "srv/pkg/box/box.go"), ("api/v1/a.proto", "v1/b.proto", "api/v1/b.proto"),
    }
    edges = resolve.edges(found, files).cache()
    calls = {(name[e.src], name[e.dst]) for e in edges.where("kind = 'CALLS'").collect()}
    assert calls == {
        ("app/main.py:run", "app/store.py:Store"), ("app/main.py:run", "app/store.py:save"), ("app/main.py:run", "app/store.py:load"), ("app/main.py:run", "app/tools.py:helper"),
        ("app/main.py:go", "app/main.py:stop"), ("app/main.py:go", "app/main.py:run"), ("app/store.py:load", "lib/other.py:lonely"),
        ("web/api.ts:call", "web/api.ts:Client"), ("web/api.ts:call", "web/api.ts:open"), ("web/api.ts:call", "web/net.ts:send"),
        ("srv/pkg/box/box.go:Put", "srv/pkg/box/box.go:fill"), ("srv/main.go:main", "srv/pkg/box/box.go:New"), ("srv/main.go:main", "srv/pkg/box/box.go:Put"),
        ("broken.py:after", "broken.py:early"),
    }
    # a TypeScript call never meets a Python definition, a generic name none of another file
    assert not [c for c in calls if c[0].startswith("web") and ".py" in c[1]] and not [c for c in calls if c[1].endswith(":get")]
    refs = {(name[e.src], name[e.dst]) for e in edges.where("kind = 'REFERENCES'").collect()}
    assert {("app/main.py:run", "app/store.py:Store"), ("app/main.py:App", "app/store.py:Store"), ("api/v1/a.proto:A", "api/v1/b.proto:B"), ("web/api.ts:call", "web/api.ts:Shape")} <= refs
    defines = {(name[e.src], name[e.dst]) for e in edges.where("kind = 'DEFINES'").collect()}
    assert ("app/main.py", "app/main.py:go") in defines and len(defines) == nodes.where("kind <> 'module'").count()
    inside = {name[c.node_id]: name[c.container] for c in resolve.containers(nodes).collect()}
    assert inside["app/main.py:go"] == "app/main.py:App" and inside["app/main.py:App"] == "app/main.py"
    asked = spark.createDataFrame([(1, "Store"), (2, "tools.py")], "qid int, name string")
    met = {(r.qid, name[r.node_id], r.relation) for r in resolve.references(edges, asked, nodes).collect()}
    assert {(1, "app/main.py:run", "CALLS"), (1, "app/main.py:App", "REFERENCES"), (2, "app/main.py", "IMPORTS")} <= met
    assert {(name[i.target], name[i.importer]) for i in resolve.importers(edges, nodes).collect()} >= {("app/store.py", "app/main.py")}


def test_only_new_blobs_are_read(spark):
    chunks, files = collection(spark)
    every = facts.file_facts(chunks)
    known = every.where("blob_hash <> 'app/main.py'")
    assert [r.blob_hash for r in facts.new_facts(chunks, known).collect()] == ["app/main.py"]
    assert rows(facts.sync_facts(chunks, known).select("blob_hash", "size")) == rows(every.select("blob_hash", "size"))
    assert facts.new_facts(chunks, known.withColumn("version", known.version - 1)).count() == every.count()
    assert facts.file_facts(chunks.limit(0)).count() == 0 and resolve.edges(every.limit(0), files).count() == 0


def test_symbols_that_a_commit_changed(spark):
    from datetime import datetime

    import pytest
    from pyspark.sql import functions as F

    from tessera.operators import recent

    code = {"h1": "def a():\n    return 1\n\n\ndef b():\n    pass\n", "h2": "def a():\n    return 2\n\n\ndef c():\n    pass\n", "h3": "class K:\n    pass\n"}
    chunks = spark.createDataFrame([(h, 0, "python", c, h, "r") for h, c in code.items()], CHUNKS)
    t = datetime(2025, 1, 1)
    files = spark.createDataFrame([("r", "s1", "m.py", "h1", t), ("r", "s2", "m.py", "H2", t), ("r", "s2", "k.py", "h3", t), ("r", "s3", "m.py", "h2", t)], "repo string, ref string, path string, blob_hash string, loaded_at timestamp_ntz")
    log = spark.createDataFrame([("r", "main", i, f"s{i}", datetime(2025, 1, i), "me", None) for i in (1, 2, 3)], "repo string, branch string, ordinal int, sha string, committed_at timestamp_ntz, author string, message string")
    found = recent.symbol_diffs(files, log.select("repo", "branch", "ordinal", "sha"), facts.file_facts(chunks))
    assert {(r.ref, r.path, r.symbol, r.change) for r in found.collect()} == {
        ("s2", "k.py", "K", "added"), ("s2", "m.py", "a", "modified"), ("s2", "m.py", "b", "removed"), ("s2", "m.py", "c", "added"), ("s3", "k.py", "K", "removed"),
    }
    few = recent.symbol_diffs(files, log.select("repo", "branch", "ordinal", "sha"), facts.file_facts(chunks), most=2)
    assert few.groupBy("ref").count().agg(F.max("count")).first()[0] == 2
    assert [r.sha for r in recent.recent_commits(log, "2025-01-02").orderBy("rank").collect()] == ["s3", "s2"]
    assert [r.sha for r in recent.recent_commits(log, "s1", 1).collect()] == ["s3"]
    with pytest.raises(ValueError, match="no such commit"):
        recent.recent_commits(log, "zz")
