"""Facts of source files: definitions with their spans, imports, calls, references and local types.

Facts do not depend on where a file lies, so each blob is read once, whatever its
paths, and only new blobs are read again (:func:`new_facts`).  Python is read by
its syntax tree; Python that does not parse and the other languages are read from
text whose comments and strings are blanked, with spans by matching brackets.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunking import joined, placed_chunks

#: Languages whose definitions may answer each other's calls.
FAMILIES = {"python": "python", "typescript": "ecma", "tsx": "ecma", "javascript": "ecma", "go": "go", "proto": "proto"}
#: Changes when facts of unchanged blobs would come out otherwise; facts of another version are read anew.
VERSION = 2
SIGNATURE = 200

DEFS = "array<struct<symbol:string,kind:string,byte_start:int,byte_end:int,signature:string,parent:string,digest:string>>"
SITES = "array<struct<name:string,at:int,within:int,receiver:string,type:string>>"
IMPORTS = "array<struct<module:string,name:string,alias:string>>"
SCHEMA = f"blob_hash string, language string, version int, size int, defs {DEFS}, imports {IMPORTS}, calls {SITES}, refs {SITES}"


class Found:
    """What one file holds, as it is read."""

    def __init__(self, data: bytes):
        self.data = data
        self.defs: list[tuple] = []
        self.imports: list[tuple] = []
        self.calls: list[tuple] = []
        self.refs: list[tuple] = []
        self.types: dict[tuple[int, str], str] = {}  # (start of the enclosing definition or -1, variable): type

    def define(self, name: str, kind: str, a: int, b: int, parent: str | None = None) -> None:
        line = self.data[a : self.data.find(b"\n", a) if b"\n" in self.data[a:b] else b].decode("utf-8", "replace")
        self.defs.append((name, kind, a, b, line.strip()[:SIGNATURE], parent, hashlib.sha1(self.data[a:b]).hexdigest()))

    def facts(self) -> tuple:
        """(defs, imports, calls, refs): ordered; of definitions of one span the first stands; sites by their innermost definition."""
        once = {}
        for d in self.defs:
            once.setdefault((d[2], d[3], d[0]), d)
        defs = sorted(once.values(), key=lambda d: (d[2], -d[3], d[0]))
        starts = [d[2] for d in defs]

        def within(at: int) -> int:
            for k in range(bisect_right(starts, at) - 1, -1, -1):
                if defs[k][1] != "const" and defs[k][3] > at:
                    return defs[k][2]
            return -1

        def placed(sites: list[tuple]) -> list[tuple]:
            out = set()
            for name, at, receiver in sites:
                inside = within(at)
                kind = self.types.get((inside, receiver)) or self.types.get((-1, receiver)) if receiver else None
                out.add((name, at, inside, receiver, kind))
            return sorted(out, key=lambda s: (s[1], s[0], s[3] or ""))

        return defs, sorted(set(self.imports), key=lambda i: tuple(x or "" for x in i)), placed(self.calls), placed(self.refs)


def _tree(data: bytes) -> ast.AST | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def read_python(data: bytes) -> Found | None:
    tree = _tree(data)
    if tree is None:
        return None
    found, starts = Found(data), [0]
    for line in data.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    at = lambda n: starts[n.lineno - 1] + n.col_offset
    end = lambda n: starts[n.end_lineno - 1] + n.end_col_offset

    def type_name(node) -> str | None:
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier():
            return node.value
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def refer(node) -> None:
        for x in ast.walk(node) if node is not None else ():
            if isinstance(x, (ast.Name, ast.Attribute)):
                found.refs.append((type_name(x), at(x), None))

    todo: list[tuple] = [(tree, -1, None)]  # node, start of the definition around it, the class around it
    while todo:
        node, scope, owner = todo.pop()
        inner_scope, inner_owner = scope, owner
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            inner_scope, inner_owner = at(node), None
            found.define(node.name, "method" if owner else "function", at(node), end(node), owner)
            args = [*node.args.posonlyargs, *node.args.args]
            if owner and args:
                found.types[inner_scope, args[0].arg] = owner
            for a in [*args, *node.args.kwonlyargs]:
                if a.annotation is not None:
                    refer(a.annotation)
                    if type_name(a.annotation):
                        found.types[inner_scope, a.arg] = type_name(a.annotation)
            refer(node.returns)
            for d in node.decorator_list:
                refer(d)
        elif isinstance(node, ast.ClassDef):
            inner_scope, inner_owner = at(node), node.name
            found.define(node.name, "class", at(node), end(node), owner)
            for d in [*node.bases, *node.decorator_list]:
                refer(d)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name):
                    if scope == -1 and t.id.isupper() and len(t.id) > 1:
                        found.define(t.id, "const", at(node), end(node))
                    if isinstance(node.value, ast.Call) and (name := type_name(node.value.func)) and name[:1].isupper():
                        found.types[scope, t.id] = name
            if isinstance(node, ast.AnnAssign):
                refer(node.annotation)
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name):
                found.calls.append((node.func.id, at(node), None))
            elif isinstance(node.func, ast.Attribute):
                found.calls.append((node.func.attr, at(node), node.func.value.id if isinstance(node.func.value, ast.Name) else None))
        elif isinstance(node, ast.Import):
            found.imports += [(a.name, None, a.asname or a.name.split(".")[0]) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found.imports += [("." * node.level + (node.module or ""), a.name, a.asname or a.name) for a in node.names]
        elif isinstance(node, ast.ExceptHandler):
            refer(node.type)
        todo += [(c, inner_scope, inner_owner) for c in ast.iter_child_nodes(node)]
    return found


_BLANKED = {
    "python": rb"#[^\n]*|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'",
    "proto": rb"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"",
}
_BLANKED_ELSE = rb"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`"
_NAME = rb"([A-Za-z_$][\w$]*)"
#: Declarations by language: (kind, pattern); group ``n`` is the name, ``p`` the type that a method belongs to.
_DECLARED = {
    "python": [("class", rb"^[ \t]*class[ \t]+(?P<n>\w+)"), ("function", rb"^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<n>\w+)")],
    "go": [
        ("method", rb"^func[ \t]*\([ \t]*(?P<v>\w+)?[ \t]*\*?[ \t]*(?P<p>\w+)(?:\[[^\]\n]*\])?[ \t]*\)[ \t]*(?P<n>\w+)"), ("function", rb"^func[ \t]+(?P<n>\w+)"),
        ("interface", rb"^type[ \t]+(?P<n>\w+)(?:\[[^\]\n]*\])?[ \t]+interface\b"), ("type", rb"^type[ \t]+(?P<n>\w+)"), ("const", rb"^(?:const|var)[ \t]+(?P<n>[A-Z]\w*)"),
    ],
    "proto": [("message", rb"^[ \t]*message[ \t]+(?P<n>\w+)"), ("enum", rb"^[ \t]*enum[ \t]+(?P<n>\w+)"), ("service", rb"^[ \t]*service[ \t]+(?P<n>\w+)"), ("method", rb"^[ \t]*rpc[ \t]+(?P<n>\w+)")],
}
_EXPORT = rb"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
_DECLARED_ELSE = [
    ("class", _EXPORT + rb"(?:abstract[ \t]+)?class[ \t]+(?P<n>[\w$]+)"), ("function", _EXPORT + rb"(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<n>[\w$]+)"),
    ("interface", _EXPORT + rb"interface[ \t]+(?P<n>[\w$]+)"), ("enum", _EXPORT + rb"(?:const[ \t]+)?enum[ \t]+(?P<n>[\w$]+)"), ("type", _EXPORT + rb"type[ \t]+(?P<n>[\w$]+)[ \t]*(?:<[^=\n]*>)?[ \t]*="),
    ("function", _EXPORT + rb"(?:const|let|var)[ \t]+(?P<n>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^()]*\)|[\w$]+)[ \t]*(?::[^=\n]+)?=>"),
    ("const", _EXPORT + rb"const[ \t]+(?P<n>[A-Z][A-Z0-9_]+)\b"),
    ("method", rb"^[ \t]+(?:(?:public|private|protected|static|async|override|readonly|get|set)[ \t]+)*\*?(?P<n>#?[A-Za-z_$][\w$]*)[ \t]*(?:<[^(\n]*>)?\([^(){}]*\)[ \t]*(?::[^{};=\n]+)?\{"),
]
_TYPED_BY = {
    "go": rb"(?P<v>\w+)[ \t]*:?=[ \t]*&?(?P<t>[A-Z]\w*)\{",
    "else": rb"(?:const|let|var)[ \t]+(?P<v>[\w$]+)[^=\n]*=[ \t]*new[ \t]+(?P<t>[\w$]+)",
}
_REFERRED = {
    "python": rb"(?!)", "go": rb"[&*\]]([A-Z]\w*)|\b([A-Z]\w*)\{", "proto": rb"^[ \t]*(?:repeated[ \t]+|optional[ \t]+)?([A-Z]\w*)[ \t]+\w+[ \t]*=|[(][ \t]*(?:stream[ \t]+)?([A-Z]\w*)[ \t]*[)]",
    "else": rb"(?:extends|implements|new|instanceof)[ \t]+([A-Z][\w$]*)|:[ \t]*([A-Z][\w$]*)",
}
_NO_CALL = frozenset("if for while switch return function catch typeof await new func go defer def class with elif assert not and or in is rpc returns import super sizeof print lambda yield del make len cap append".split())
_IMPORTED = {
    "python": re.compile(rb"(?m)^[ \t]*(?:from[ \t]+(?P<m>[.\w]+)[ \t]+import[ \t]+(?P<n>\w+)|import[ \t]+(?P<i>[\w.]+))"),
    "proto": re.compile(rb"(?m)^[ \t]*import[ \t]+(?:public[ \t]+|weak[ \t]+)?\"(?P<i>[^\"\n]+)\""),
    "go": re.compile(rb"(?m)^[ \t]*(?:import[ \t]+)?(?P<a>[\w.]+[ \t]+)?\"(?P<i>[^\"\n]+)\"[ \t]*$"),
}
_FROM = re.compile(rb"(?m)^[ \t]*(?:import|export)[ \t]+(?:type[ \t]+)?(?P<what>[^'\";]*?)[ \t\n]*(?:from[ \t]*)?(?:'(?P<a>[^'\n]+)'|\"(?P<b>[^\"\n]+)\")|require\([ \t]*['\"](?P<c>[^'\"\n]+)['\"][ \t]*\)")
_GO_IMPORTS = re.compile(rb"(?m)^import[ \t]*(?:\([^)]*\)|[^\n]*)")


def read_outline(data: bytes, language: str) -> Found:
    """By declaration patterns on blanked text; a span ends where the first bracket after its head closes, else with its line."""
    found = Found(data)
    blank = re.sub(_BLANKED.get(language, _BLANKED_ELSE), lambda m: re.sub(rb"[^\n]", b" ", m[0]), data)
    match, stack = {}, []
    for m in re.finditer(rb"[{}]", blank):
        if m[0] == b"{":
            stack.append(m.start())
        elif stack:
            match[stack.pop()] = m.end()
    text = lambda b: b.decode("utf-8", "replace")
    heads, classes = set(), []
    for kind, rx in _DECLARED.get(language, _DECLARED_ELSE):
        for m in re.finditer(rb"(?m)" + rx, blank):
            a, name = m.start() + len(m[0]) - len(m[0].lstrip()), text(m["n"])
            if kind == "method" and name in _NO_CALL:
                continue
            line = blank.find(b"\n", m.end())
            line = len(blank) if line < 0 else line
            brace = blank.find(b"{", m.end() - 1, line if kind != "method" or language != "go" else line)
            b = match.get(brace, line) if brace >= 0 else line
            if language == "python":
                b = _block_end(blank, a, line)
            parent = text(m["p"]) if "p" in m.groupdict() and m["p"] else None
            if kind in ("class", "interface", "service"):
                classes.append((a, b, name))
            if kind in ("method", "function") and parent is None:
                around = [c for c in classes if c[0] < a < c[1]]
                parent = max(around)[2] if around else None
                if kind == "method" and parent is None:
                    continue
                kind = "method" if parent else kind
            found.define(name, kind, a, b, parent)
            heads.add(m.start("n"))
            if parent and "v" in m.groupdict() and m["v"]:
                found.types[a, text(m["v"])] = parent
            elif parent:
                found.types[a, "this"] = parent
    for m in re.finditer(rb"(?:([A-Za-z_$][\w$]*)[ \t]*\??\.[ \t]*)?([A-Za-z_$][\w$]*)[ \t]*(?:<[\w$, ]*>)?\(", blank):
        if m.start(2) not in heads and text(m[2]) not in _NO_CALL:
            found.calls.append((text(m[2]), m.start(2), text(m[1]) if m[1] else None))
    for m in re.finditer(rb"(?m)" + _REFERRED.get(language, _REFERRED["else"]), blank):
        g = 1 if m[1] else 2
        found.refs.append((text(m[g]), m.start(g), None))
    for m in re.finditer(_TYPED_BY.get(language, _TYPED_BY["else"]), blank):
        inside = max((d[2] for d in found.defs if d[2] <= m.start() < d[3] and d[1] in ("function", "method")), default=-1)
        found.types[inside, text(m["v"])] = text(m["t"])
    if language == "go":
        for part in _GO_IMPORTS.finditer(data):
            for m in _IMPORTED["go"].finditer(part[0].replace(b"(", b"\n").replace(b")", b"\n").replace(b"import ", b"import ")):
                path = text(m["i"])
                found.imports.append((path, None, text(m["a"]).strip() if m["a"] else path.rsplit("/", 1)[-1]))
    elif language in _IMPORTED:
        for m in _IMPORTED[language].finditer(data if language == "proto" else blank):
            whole = text(m["i"]) if m["i"] else None
            found.imports.append((whole, None, whole.split(".")[0]) if whole else (text(m["m"]), text(m["n"]), text(m["n"])))
    else:
        for m in _FROM.finditer(data):
            module, what = text(m["a"] or m["b"] or m["c"]), text(m["what"] or b"")
            names = re.findall(r"([\w$]+)(?:\s+as\s+([\w$]+))?", what.replace("type ", ""))
            found.imports += [(module, n, alias or n) for n, alias in names] or [(module, None, None)]
    return found


def _block_end(blank: bytes, a: int, line: int) -> int:
    """Where the indented block behind a head ends."""
    margin = a - (blank.rfind(b"\n", 0, a) + 1)
    at, end = line + 1, line
    while at < len(blank):
        e = blank.find(b"\n", at)
        e = len(blank) if e < 0 else e
        body = blank[at:e]
        if body.strip():
            if len(body) - len(body.lstrip()) <= margin:
                break
            end = e
        at = e + 1
    return end


def read_facts(data: bytes, language: str) -> tuple:
    """(defs, imports, calls, refs) of one file."""
    found = read_python(data) if language == "python" else None
    return (found or read_outline(data, language)).facts()


def file_facts(chunks: DataFrame) -> DataFrame:
    """One row a blob (SCHEMA), from its chunks put together; text and unknown languages have none.

    ``within`` of a site is the start of the innermost definition around it, -1
    outside of all; ``type`` is the type of its receiver where the file tells it.
    A blob with a gap is read up to it.  Copies of a chunk row count once; null
    hash, place or code gives no row; empty tables give none.
    """
    schema = pa.schema(
        [("blob_hash", pa.string()), ("language", pa.string()), ("version", pa.int32()), ("size", pa.int32())]
        + [("defs", pa.list_(pa.struct([("symbol", pa.string()), ("kind", pa.string()), ("byte_start", pa.int32()), ("byte_end", pa.int32()), ("signature", pa.string()), ("parent", pa.string()), ("digest", pa.string())])))]
        + [("imports", pa.list_(pa.struct([("module", pa.string()), ("name", pa.string()), ("alias", pa.string())])))]
        + [(n, pa.list_(pa.struct([("name", pa.string()), ("at", pa.int32()), ("within", pa.int32()), ("receiver", pa.string()), ("type", pa.string())]))) for n in ("calls", "refs")]
    )
    fields = {n: [f.name for f in schema.field(n).type.value_type] for n in ("defs", "imports", "calls", "refs")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for blob, language, start, data in joined(batches):
            if start == 0:
                row = {"blob_hash": blob, "language": language, "version": VERSION, "size": len(data)}
                for n, values in zip(("defs", "imports", "calls", "refs"), read_facts(data, language)):
                    row[n] = [dict(zip(fields[n], v)) for v in values]
                rows.append(row)
            if len(rows) == 200:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return placed_chunks(chunks.where(F.col("language").isin(*FAMILIES))).mapInArrow(run, SCHEMA)


def new_facts(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """Facts of the blobs that ``known`` lacks or has in another version; the rest is not read."""
    done = known.where(F.col("version") == VERSION).select(F.col("blob_hash").alias("_done")).distinct()
    return file_facts(chunks.join(done, F.lower("blob_hash") == F.col("_done"), "left_anti"))


def sync_facts(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` brought up to date: rows of this version stay as they are, missing ones are read."""
    return known.where(F.col("version") == VERSION).unionByName(new_facts(chunks, known))
