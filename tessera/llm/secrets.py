"""Credentials embedded in source code and configuration.

Places are assignments to names that stand for a secret, headers, addresses with
a password, command-line options, comments, key blocks and tokens with a known
prefix.  A literal there is segmented into dictionary words by Viterbi; a long
residual that no word explains, or the make-up of a chosen password, makes it a
credential.  The dictionary are the words of the collection itself, by the
number of chunks that hold them, so names and prose explain themselves.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dictionary word is in at least this share of the chunks and this many of them.  A chunk has
#: few hundred words, so there are at most a few hundred times 1 / WORD_SHARE such words.
WORD_SHARE, WORD_LEAST, WORD_LONGEST = 5e-4, 4, 24
LEAST_VALUE, LEAST_RESIDUAL = 8, 5

#: Fixed formats of issued tokens: how they begin, and go on.
_FORMATS = (
    ("AKIA", "[A-Z0-9]{16}(?![A-Za-z0-9])"), ("ASIA", "[A-Z0-9]{16}(?![A-Za-z0-9])"), ("gh[opsru]_", "[A-Za-z0-9]{20,}"), ("github_pat_", r"\w{20,}"), ("glpat-", r"[\w-]{16,}"),
    ("sk_(?:live|test)_", "[A-Za-z0-9]{16,}"), ("rk_(?:live|test)_", "[A-Za-z0-9]{16,}"), ("xox[abeprs]-", r"[\w-]{16,}"), ("AIza", r"[\w-]{30,}"),
    ("hf_", "[A-Za-z0-9]{24,}"), ("npm_", "[A-Za-z0-9]{30,}"), (r"SG\.", r"[\w-]{16,}\.[\w-]{16,}"), ("sk-(?:proj|ant|live)-", r"[\w-]{20,}"), ("shp(?:at|ss|ca)_", "[a-fA-F0-9]{24,}"), ("dop_v1_", "[a-f0-9]{40,}"),
    ("eyJ", r"[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"), ("LS0tLS1CRUdJTi", "[A-Za-z0-9+/=]{20,}"),
)
_ISSUED = re.compile(r"(?<![A-Za-z0-9_/+-])(?:" + "|".join(head + rest for head, rest in _FORMATS) + ")")
_ISSUED_HEAD = re.compile(r"(?:(?:AKIA|ASIA)[A-Z0-9]{4,}|gh[opsru]_[A-Za-z0-9]{6,}|glpat-[\w-]{4,}|[sr]k_(?:live|test)_\w{4,}|xox[abeprs]-[\w-]{6,}|AIza[\w-]{6,}|eyJ[\w-]{8,})")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ENCODED_LINES = re.compile(r"(?:(?:\\[nr]|[\s\"'`+,|#*])*[A-Za-z0-9+/=]{16,}|[ \t\"'`+,|#*\r\n\\]*(?:Proc-Type|DEK-Info|Version|Comment): [^\n]*)*+(?:(?:\\[nr]|[\s\"'`+,|#*])*[A-Za-z0-9+/=]+)?")
_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://[^\s/:@\"'`]*:([^\s@/\"'`]+)@", re.I)
_PAIR = re.compile(
    r"(?P<name>[A-Za-z_][\w.-]*)(?P<shut>\\?[\"'`]?\s*\]?)\s*(?P<op>:=|=>|=|:|,)\s*(?P<mark>(?:\b[bBrRuUfF]{1,2})?(?P<quote>\\?[\"'`]))?"
)
_OPTION = re.compile(r"--(?P<name>[A-Za-z][\w-]*)(?:=|\s+)[\"']?(?P<value>[^\s\"'`]+)")
_USER = re.compile(r"(?:\bcurl\b[^\n]*?\s-u|--user)[ =][\"']?[^\s:\"']+:(?P<value>[^\s\"'`]+)")
_CLIENT = re.compile(
    r"\bidentified by\s+\\?['\"](?P<sql>[^'\"\\]+)|\b(?:mysql\w*|mariadb\w*|sshpass)\b[^\n\"'`]*?\s-p\s?(?P<p>[^\s\"'`-][^\s\"'`]*)"
    r"|\bredis-cli\b[^\n\"'`]*?\s-a\s+(?P<a>[^\s\"'`]+)",
    re.I,
)
_HEADER = re.compile(r"\b(?P<kind>Basic|Bearer)\s+(?P<value>[A-Za-z0-9._~+/=-]{8,})")
_PHRASE = re.compile(r"(?P<name>(?:[A-Za-z_]\w*[ ]){1,4}?[A-Za-z_]\w*):\s+[\"'`]?(?P<value>[^\s\"'`]+)[\"'`]?\s*(?:\*/)?\s*$")
_COMMENT = re.compile(r"^\s*(?://|#|/?\*|--|;|<!--)")
_OPEN = re.compile(r"(?P<name>[A-Za-z_][\w.-]*)(?:\\?[\"'`]?\s*\]?)\s*(?::=|=|:)\s*(?:\(|\[|[|>][+-]?)?\s*$")
_PART = re.compile(r"^\s*(?:[bBrRuUfF]{1,2})?[\"'`]([^\"'`]*)[\"'`]\s*\+?\s*\)?,?;?\s*$")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_DIGEST = re.compile(r"(?:sha-?\d+|md5|crc32|blake2b?)[:=-]", re.I)
#: Known formats of password hashes: they are made to be kept.
_HASHED = re.compile(r"\$(?:2[abxy]?|argon2(?:id|i|d)|1|5|6|y|scrypt|pbkdf2[\w-]*)\$|\{(?:S?SHA\d*|MD5|CRYPT)\}|pbkdf2_sha\d+\$", re.I)
_HEX = re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}")
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|%\(|<[^>]*>|^\$[A-Za-z_]|^%[A-Za-z_]|^(?:os|process|env|vault|secrets?|config|settings|self|this)\b[.\[]|^(?:arn|vault|file|env|ref|ssm):", re.I)
_STOPS = frozenset(
    "changeme change_me change-me example placeholder dummy todo fixme redacted none null nil true false undefined unset default empty"
    " masked hidden removed test testing sample xxx foo bar secret password passwd token".split()
)
_WORDS_OF_SECRETS = frozenset("password passwd passphrase pwd secret token credential credentials apikey".split())
_KEY_KINDS = frozenset("api private signing encryption access auth secret client master service account session ssh deploy shared".split())
_NO_VALUE = frozenset(
    "label labels file files path dir folder name names hint url uri type types length len size field ttl expiry expires prompt message"
    " regex pattern policy digest hash checksum sha commit revision rev fingerprint limit count bucket env var id ids".split()
)
_COMMON = frozenset("your here my the own insert value example client access refresh auth api key token secret password webhook smtp db pass user admin".split())

# What a line must hold for any place of a secret in it: each name that ``stands_for_secret`` takes holds one of
# the first three, each format has its beginning, and addresses, headers and commands the words they are told by.
# All alternatives begin with a letter or sign, which lets the search skip; those of _LOWER want lower-cased text.
_LOWER = (
    re.compile("|".join(sorted(_WORDS_OF_SECRETS))),
    re.compile(f"(?:{'|'.join(sorted(_KEY_KINDS))})(?:[ .-]|[^\\Wa-z])*key"),
    re.compile(r"://[^\s/:@\"'`]*:[^\s@/\"'`]+@|basic\s|bearer\s|curl|--user[ =]|identified by|mysql|mariadb|sshpass|redis-cli"),
)
_CASED = re.compile(
    r"pass(?<![A-Za-z]pass)(?![a-z])|Pass(?![a-z])|PASS(?<![A-Z]PASS)(?![a-z])"
    r"|auth(?<![A-Za-z]auth)(?![A-Za-z])|Auth(?<![A-Za-z]Auth)(?![A-Za-z])|AUTH(?<![A-Za-z]AUTH)(?![A-Za-z])|"
    + "|".join(head for head, _ in _FORMATS)
)


def _candidate_lines(text: str) -> list[int]:
    """Where the lines begin that may hold the place of a secret."""
    low = text.lower()
    if len(low) != len(text):  # some letters become two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = [m.start() for rx in _LOWER for m in rx.finditer(low)] + [m.start() for m in _CASED.finditer(text)]
    return sorted({text.rfind("\n", 0, at) + 1 for at in found})


def stands_for_secret(name: str) -> bool:
    """Whether a name, in any spelling, is that of a secret value."""
    words = [w.lower() for w in _PARTS.findall(name) if not w.isdigit()]
    clean, k = [], 0
    while k < len(words):
        if words[k] == "token" and k + 1 < len(words) and words[k + 1] == "bucket":
            k += 2
            continue
        clean.append(words[k])
        k += 1
    # a numbered name ends in whatever told it from others, not in what it holds
    if not clean or (clean[-1] in _NO_VALUE and not name[-1:].isdigit()) or "public" in clean or "pub" in clean:
        return False
    for i, w in enumerate(clean):
        if w in _WORDS_OF_SECRETS:
            return True
        if w == "pass" and (i or len(clean) == 1):
            return True
        if w == "key" and i and clean[i - 1] in _KEY_KINDS:
            return True
    return clean == ["auth"]


class Dictionary:
    """Unigram costs, and the segmentation that explains a literal at least cost."""

    def __init__(self, counts: dict[str, int]):
        total = max(1, sum(counts.values()))
        self.cost = {w: math.log(total / n) + 1 for w, n in counts.items() if len(w) > 2}
        for w in _COMMON:
            self.cost.setdefault(w, 6.0)

    def residual(self, literal: str) -> int:
        """Letters and digits that no dictionary word and no short number explains."""
        out = 0
        for run in re.findall(r"[A-Za-z]+|\d+", literal):
            if run.isdigit():
                out += len(run) if len(run) > 5 else 0
                continue
            s = run.lower()
            best: list[tuple[float, int]] = [(0.0, 0)]
            for j in range(1, len(s) + 1):
                top = (best[j - 1][0] + 9.0, best[j - 1][1] + 1)
                for i in range(max(0, j - WORD_LONGEST), j - 2):
                    c = self.cost.get(s[i:j])
                    if c is not None and best[i][0] + c < top[0]:
                        top = (best[i][0] + c, best[i][1])
                best.append(top)
            out += best[-1][1]
        return out


def is_credential(value: str, words: Dictionary, least: int = LEAST_VALUE) -> bool:
    """Whether a literal in the place of a secret is one."""
    v = value.strip()
    low = v.lower()
    if len(v) < least or any(ch.isspace() for ch in v) or low in _STOPS or _REFERENCE.search(v) or len(set(v)) < 4:
        return False
    if re.search(r"\*{3,}|x{4,}|\.{3,}", v, re.I) or re.match(r"(?:your|my|insert|enter|put)[-_]", low):
        return False
    if _UUID.fullmatch(v) or _DIGEST.match(v) or _HASHED.match(v):
        return False
    if _HEX.fullmatch(v):  # only named places ask; names of digests and commits stand for no secret
        return any(c.isdigit() for c in v)
    if _ISSUED_HEAD.match(v):
        return True
    left = words.residual(v)
    if re.match(r"(?:\.{0,2}/|[A-Za-z]:\\|[\w.-]+/)[\w./-]*$", v) and "/" in v and left < len(v) * 0.4:
        return False
    if left >= LEAST_RESIDUAL and left >= len(v) * 0.25:
        return True
    kinds = (bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    return sum(kinds) >= 3 and sum(ch.isdigit() for ch in v) >= 2 and not re.match(r"[\w.-]+:\w", v)


def _plain_name(v: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_][\w.]*(?:\(.*)?|\d+(?:\.\d+)?", v))


def credentials(text: str, words: Dictionary, code: bool = True) -> list[list[tuple[int, int]]]:
    """The (start, end) parts of every credential of a text, in order; positions count characters.

    A value written as several string literals has one part for each of them.
    """
    hits: dict[int, list[tuple[int, int]]] = {}

    def take(a: int, b: int, more: list[tuple[int, int]] = []) -> None:
        for parts in hits.values():
            if any(a < e and s < b for s, e in parts):
                return
        hits[a] = [(a, b), *more]

    for m in _KEY_BLOCK.finditer(text):
        end = text.find("-----END", m.end())
        if end < 0:  # a block that is cut off goes on as long as its lines are encoded
            rest = _ENCODED_LINES.match(text, m.end())
        body = text[m.end() : end if end >= 0 else rest.end()]
        bare = re.sub(r"\\n|[\s\"'+,|]", "", body)
        if not bare or re.match(r"[A-Za-z0-9/=:;-]{16,}", bare):
            close = text.find("-----", end + 8) + 5 if end >= 0 else m.end() + len(body)
            take(m.start(), max(close, m.end()))

    for a in _candidate_lines(text):
        b = text.find("\n", a)
        b = len(text) if b < 0 else b
        _line(text, a, b, words, code, take)
    return [hits[a] for a in sorted(hits)]


def _line(text: str, a: int, b: int, words: Dictionary, code: bool, take) -> None:
    line = text[a:b]
    for m in _ISSUED.finditer(line):
        if m[0].startswith("LS0t") and "PRIVATE KEY" not in _decoded(m[0]):
            continue
        take(a + m.start(), a + m.end())
    for m in _ADDRESS.finditer(line):
        v = m[1]
        if not _REFERENCE.search(v) and v.lower() not in _STOPS and not re.search(r"\*{3,}|x{4,}", v, re.I) and words.residual(v) + sum(c.isdigit() for c in v) >= 2:
            take(a + m.start(1), a + m.end(1))
    for m in _HEADER.finditer(line):
        v = m["value"]
        pair = _decoded(v)
        real = is_credential(pair.split(":", 1)[1], words, 6) if m["kind"] == "Basic" and ":" in pair else is_credential(v, words)
        if real and (m["kind"] == "Bearer" or ":" in pair):
            take(a + m.start("value"), a + m.end("value"))
    for rx, least in ((_OPTION, LEAST_VALUE), (_USER, 6)):
        for m in rx.finditer(line):
            v = m["value"].rstrip(".,;)")
            if (rx is _USER or stands_for_secret(m["name"])) and is_credential(v, words, least):
                take(a + m.start("value"), a + m.start("value") + len(v))
    for m in _CLIENT.finditer(line):
        at = next(g for g in ("sql", "p", "a") if m[g])
        if is_credential(m[at], words, 6):
            take(a + m.start(at), a + m.end(at))
    if _COMMENT.match(line) or not code:
        m = _PHRASE.search(line)
        if m and stands_for_secret(m["name"].replace(" ", "_")) and is_credential(m["value"], words):
            take(a + m.start("value"), a + m.end("value"))
    for m in _PAIR.finditer(line):
        if m["op"] == "," and not (m["quote"] and re.match(r"\\?[\"'`]", m["shut"])):
            continue
        if not stands_for_secret(m["name"]):
            continue
        at = m.end()
        if m["quote"]:
            end = line.find(m["quote"], at)
            v = line[at : end if end >= 0 else len(line)]
            more = _parts_after(text, b) if end >= 0 and re.match(r"\s*\+\s*$", line[end + len(m["quote"]) :]) else []
            if is_credential(v + "".join(text[x:y] for x, y in more), words):
                take(a + at, a + at + len(v), more)
        else:
            v = re.match(r"[^\s,;)}\]\"'`]*", line[at:])[0]
            if "=" in m["op"] and re.search(r"[?&;][\w.-]*$", line[: m.start("name") + 1] + m["name"]):
                v = re.split(r"[&;]", v)[0]
            if v and is_credential(v, words) and not (code and _plain_name(v) and words.residual(v) < LEAST_RESIDUAL):
                take(a + at, a + at + len(v))
    m = _OPEN.search(line)
    if m and stands_for_secret(m["name"]):
        start, parts = b + 1, _parts_after(text, b)
        nxt = text[start : text.find("\n", start) if text.find("\n", start) >= 0 else len(text)]
        if not parts and re.search(r"[|>][+-]?\s*$", line) and nxt.strip():
            parts = [(start + len(nxt) - len(nxt.lstrip()), start + len(nxt.rstrip()))]
        whole = "".join(text[x:y] for x, y in parts)
        if parts and not whole.startswith("-----BEGIN") and is_credential(whole, words):
            take(*parts[0], parts[1:])


def _parts_after(text: str, at: int) -> list[tuple[int, int]]:
    """Places of the string literals that alone fill the lines after ``at``."""
    out = []
    while at < len(text):
        e = text.find("\n", at + 1)
        e = len(text) if e < 0 else e
        p = _PART.match(text[at + 1 : e])
        if not p:
            break
        out.append((at + 1 + p.start(1), at + 1 + p.end(1)))
        at = e
    return out


def _decoded(v: str) -> str:
    try:
        return base64.b64decode(v + "=" * (-len(v) % 4)).decode("utf-8", "ignore")
    except (binascii.Error, ValueError):
        return ""


def dictionary(chunks: DataFrame) -> Dictionary:
    """The words of the collection by the number of chunks that hold them.

    Names are split at capitals and underscores.  Counting is a partial
    aggregation over all chunks; only words above the share reach the driver.
    """
    spaced = F.regexp_replace(F.col("code"), r"(?<=[a-z])(?=[A-Z])", " ")
    rows = chunks.where("code is not null").select(F.explode(F.array_distinct(F.split(F.lower(spaced), "[^a-z]+"))).alias("word"))
    counts = rows.where(F.length("word").between(3, WORD_LONGEST)).groupBy("word").agg(F.count("*").alias("n"))
    n = chunks.count()
    kept = counts.where(F.col("n") >= max(WORD_LEAST, WORD_SHARE * n))
    return Dictionary({r["word"]: r["n"] for r in kept.collect()})


def _scan(chunks: DataFrame, columns: dict[str, pa.DataType], ddl: str, emit, words: Dictionary | None) -> DataFrame:
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(words or dictionary(chunks))
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for id_, text, lang in zip(*(batch.column(n).to_pylist() for n in ("chunk_id", "code", "language"))):
                for row in emit(id_, text, credentials(text, shared.value, lang != "text")):
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, columns[n]) for c, n in zip(cols, names)], names=names)

    return chunks.where("code is not null").select("chunk_id", "code", "language").mapInArrow(run, ddl)


def find_credentials(chunks: DataFrame, words: Dictionary | None = None) -> DataFrame:
    """(chunk_id, line_no, byte_start, byte_end): where each credential begins and ends within its chunk.

    Lines end at LF and count from 1.  Null and empty code has none; copies of a
    row count once; other columns are not read.
    """

    def emit(id_, text, found):
        for (a, b), *_ in found:
            yield id_, text.count("\n", 0, a) + 1, len(text[:a].encode()), len(text[:b].encode())

    columns = {"chunk_id": pa.string(), "line_no": pa.int32(), "byte_start": pa.int32(), "byte_end": pa.int32()}
    return _scan(chunks, columns, "chunk_id string, line_no int, byte_start int, byte_end int", emit, words).distinct()


def redact(chunks: DataFrame, words: Dictionary | None = None) -> DataFrame:
    """(chunk_id, code) with every credential blanked by as many asterisks as it has characters.

    Line ends, quotes and all text around stay, so code that parsed still parses
    and lines keep their numbers.  Chunks without credentials come out as they are.
    """

    def emit(id_, text, found):
        for a, b in sorted((p for parts in found for p in parts), reverse=True):
            # of a key block only the encoded lines go, so that what holds them together stays
            hidden = r"[A-Za-z0-9+/=]{16,}" if text.startswith("-----BEGIN", a) else r"[^\s]+"
            text = text[:a] + re.sub(hidden, lambda m: "*" * len(m[0]), text[a:b]) + text[b:]
        yield id_, text

    return _scan(chunks, {"chunk_id": pa.string(), "code": pa.string()}, "chunk_id string, code string", emit, words)
