"""What is taken into the index: path rules, languages, content keys, activation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import base_name

#: Folders, lock files and suffixes that are never indexed, the size limit, and the languages by suffix.
SKIPPED_FOLDERS = (
    "node_modules", "bower_components", "vendor", "vendored", "third_party", "dist", "build", "__pycache__", ".venv", "venv",
    ".tox", ".cache", ".mypy_cache", ".pytest_cache",
)
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Pipfile.lock", "Cargo.lock", "Gemfile.lock",
    "composer.lock", "go.sum",
)
MINIFIED_SUFFIXES = (".min.js", ".min.css", ".bundle.js", ".map")
MOST_BYTES = 2 * 1024 * 1024
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "tsx", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".go": "go", ".proto": "proto",
}
SNIFFED_BYTES = 8192


def is_skipped(path: Column, size: Column, extra: Column | None = None) -> Column:
    """Too large, below a skipped folder, a lock file or minified; ``extra`` is a user's rule."""
    folders = F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/")
    rule = (
        (F.coalesce(size, F.lit(0)) > MOST_BYTES)
        | F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS)))
        | base_name(path).isin(*LOCK_FILES)
    )
    for suffix in MINIFIED_SUFFIXES:
        rule = rule | path.endswith(suffix)
    return rule if extra is None else rule | extra


def glob_pattern(glob: str) -> str:
    """A glob as an anchored expression; a star crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "[":
            j = glob.find("]", i + 1)
            if j < 0:
                out += r"\["
            else:
                body = glob[i:j].replace("\\", r"\\")
                out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
                i = j + 1
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
    return f"^(?s:{out})$"


def matches_ignore(path: Column, rules: list[str]) -> Column:
    """A user's ignore rules: ``dir/`` a folder of that name, ``/x`` a glob on the whole path,
    else a glob on the path or its base name.  Blank rules and comments are none."""
    hit = F.lit(False)
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith("#"):
            continue
        if rule.endswith("/"):
            hit = hit | F.array_contains(F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/"), rule[:-1])
        elif rule.startswith("/"):
            hit = hit | path.rlike(glob_pattern(rule[1:]))
        else:
            hit = hit | path.rlike(glob_pattern(rule)) | base_name(path).rlike(glob_pattern(rule))
    return hit


def is_binary(content: Column) -> Column:
    """A NUL byte among the first 8 KiB."""
    return F.contains(F.substring(content, 1, SNIFFED_BYTES), F.unhex(F.lit("00")))


def language_of(path: Column) -> Column:
    """By suffix, in any letter case; ``text`` for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))), F.lit("text"))


def blob_hash(content: Column) -> Column:
    """The object name git gives to a file of this content."""
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string"))
    return F.sha1(F.concat(F.encode(head, "UTF-8"), F.unhex(F.lit("00")), content))


def first_paths(files: DataFrame) -> DataFrame:
    """(blob_hash, path, n_paths): each content once, under its first path."""
    return files.where("blob_hash is not null").groupBy("blob_hash").agg(
        F.min("path").alias("path"), F.countDistinct("path").cast("long").alias("n_paths")
    )


def activation(known: DataFrame, desired: DataFrame) -> DataFrame:
    """(blob_hash, action) that turns ``known`` (blob_hash, active) into the ``desired`` set.

    ``index`` for new content, ``reactivate`` and ``deactivate`` for known; what
    stays as it is has no row.  Of several known rows of a blob any active one counts.
    """
    have = known.where("blob_hash is not null").groupBy("blob_hash").agg(F.max(F.coalesce("active", F.lit(False))).alias("active"))
    want = desired.select("blob_hash").where("blob_hash is not null").distinct().withColumn("wanted", F.lit(True))
    joined = have.join(want, "blob_hash", "full_outer")
    action = (
        F.when(F.col("active").isNull(), "index")
        .when(F.col("wanted") & ~F.col("active"), "reactivate")
        .when(F.col("wanted").isNull() & F.col("active"), "deactivate")
    )
    return joined.select("blob_hash", action.alias("action")).where("action is not null")


def upsert_blobs(known: DataFrame, new: DataFrame) -> DataFrame:
    """(blob_hash, language, size_bytes, active): new rows are active; language and size of the first insert stay."""
    fresh = new.groupBy("blob_hash").agg(F.min_by("language", "language").alias("language_n"), F.min("size_bytes").alias("size_n"))
    return known.join(fresh, "blob_hash", "full_outer").select(
        "blob_hash",
        F.coalesce("language", "language_n").alias("language"),
        F.coalesce("size_bytes", "size_n").alias("size_bytes"),
        (F.col("language_n").isNotNull() | F.col("size_n").isNotNull() | F.coalesce("active", F.lit(False))).alias("active"),
    )
