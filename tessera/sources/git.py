"""A data source over git repositories: ``spark.read.format("gitrepo")``.

Options: ``path`` of the repository, ``mode`` (tree, blobs, sources or log), ``rev``
(default HEAD), ``since`` (of log: a revision or an ISO date), ``slices``.  ``tree`` lists regular files of a revision (no links,
no submodules), ``blobs`` their content too, ``sources`` that of source files only, ``log`` commits with the files they
touch.  Listing is one git call at planning; contents are read by the tasks, a
slice of object names each, through one ``cat-file --batch``, a bounded number of
objects at a time.  As a stream, ``log`` delivers the commits between two
revisions; offsets are commit names, so a history that was rewritten delivers
what the old name does not reach.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.operators.ingest import LANGUAGES

SCHEMAS = {
    "tree": "path string, blob_hash string, size_bytes long",
    "blobs": "path string, blob_hash string, content binary",
    "sources": "path string, blob_hash string, content binary",
    "log": "ordinal int, sha string, committed_at string, author string, message string, files array<struct<status:string,path:string>>",
}


#: Objects read by one call, so that their contents are held at once.
OBJECTS = 64


class NotARepository(ValueError):
    pass


def git(path: str, *args: str, stdin: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", path, *args], input=stdin, capture_output=True)
    if done.returncode:
        raise ValueError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return done.stdout


def open_repository(path: str) -> str:
    """The root of the repository that holds ``path``."""
    try:
        return git(path, "rev-parse", "--show-toplevel").decode().strip()
    except (ValueError, OSError) as error:
        raise NotARepository(f"{path}: no git repository") from error


def head(path: str, rev: str = "HEAD") -> str | None:
    """The name of the commit of a revision, None if there is none yet."""
    try:
        return git(path, "rev-parse", "--verify", "-q", f"{rev}^{{commit}}").decode().strip()
    except ValueError:
        return None


def tree(path: str, rev: str = "HEAD") -> list[tuple[str, str, int]]:
    """(path, blob, size) of the regular files of a revision; none if nothing was committed yet."""
    if rev == "HEAD":
        try:
            git(path, "rev-parse", "--verify", "-q", "HEAD")
        except ValueError:
            return []
    out = []
    for entry in git(path, "ls-tree", "-r", "-l", "-z", rev).split(b"\0"):
        if entry:
            head, _, name = entry.partition(b"\t")
            mode, kind, blob, size = head.split()
            if kind == b"blob" and mode in (b"100644", b"100755"):
                out.append((name.decode("utf-8", "replace"), blob.decode(), int(size)))
    return out


def contents(path: str, blobs: list[str]) -> Iterator[tuple[str, bytes]]:
    """(blob, bytes) of the objects there are; missing ones are passed over."""
    data = git(path, "cat-file", "--batch", stdin="".join(f"{b}\n" for b in blobs).encode())
    at = 0
    while at < len(data):
        end = data.index(b"\n", at)
        head = data[at:end].split()
        at = end + 1
        if head[-1] == b"missing":
            continue
        size = int(head[2])
        yield head[0].decode(), data[at : at + size]
        at += size + 1


def log(path: str, rev: str = "HEAD", since: str | None = None) -> list[tuple]:
    """Commits from the oldest, numbered from 0, with status and path of what they touch (renames as two).

    ``since`` is a revision, whose commits are left out, or an ISO date (a bare
    one is midnight UTC); one that is neither raises ValueError.
    """
    limit: list[str] = []
    if since is not None:
        if re.fullmatch(r"\d{4}-\d\d-\d\d([T ].*)?", since):
            limit = [f"--since={since}T00:00:00Z" if len(since) == 10 else f"--since={since}"]
        else:
            git(path, "rev-parse", "--verify", "-q", f"{since}^{{commit}}")
            rev = f"{since}..{rev}"
    try:
        text = git(path, "log", *limit, "--reverse", "--no-renames", "--name-status", "--date=iso-strict", "--format=%x01%H%x02%cI%x02%an%x02%s", rev).decode("utf-8", "replace")
    except ValueError:
        return []
    out = []
    for n, part in enumerate(text.split("\x01")[1:]):
        head, *lines = part.strip("\n").split("\n")
        sha, when, who, what = head.split("\x02")
        files = [tuple(x.split("\t", 1)) for x in lines if "\t" in x]
        out.append((n, sha, when, who, what, files))
    return out


class Slice(InputPartition):
    def __init__(self, rows: list):
        super().__init__(rows)


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.mode, self.rev = open_repository(options["path"]), options.get("mode", "tree"), options.get("rev", "HEAD")
        self.slices, self.since = int(options.get("slices", 8)), options.get("since")

    def partitions(self) -> list[Slice]:
        rows = log(self.repo, self.rev, self.since) if self.mode == "log" else tree(self.repo, self.rev)
        if self.mode == "sources":
            rows = [r for r in rows if "." + r[0].rsplit(".", 1)[-1].lower() in LANGUAGES and "." in r[0].rsplit("/", 1)[-1]]
        n = max(1, min(self.slices, len(rows)))
        return [Slice(rows[i::n]) for i in range(n)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        rows = partition.value
        if self.mode not in ("blobs", "sources"):
            yield from rows
            return
        by: dict[str, list[str]] = {}
        for path, blob, _ in rows:
            by.setdefault(blob, []).append(path)
        names = list(by)
        for at in range(0, len(names), OBJECTS):
            for blob, data in contents(self.repo, names[at : at + OBJECTS]):
                for path in by[blob]:
                    yield path, blob, data


class GitLogStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.repo, self.rev = open_repository(options["path"]), options.get("rev", "HEAD")

    def initialOffset(self) -> dict:
        return {"commit": ""}

    def latestOffset(self) -> dict:
        return {"commit": head(self.repo, self.rev) or ""}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if not end["commit"]:
            return [Slice([])]
        rows = log(self.repo, end["commit"], start["commit"] or None)
        n = max(1, min(8, len(rows)))
        return [Slice(rows[i::n]) for i in range(n)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from partition.value


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitrepo"

    def schema(self) -> str:
        mode = self.options.get("mode", "tree")
        if mode not in SCHEMAS:
            raise ValueError(f"mode must be one of {', '.join(SCHEMAS)}")
        return SCHEMAS[mode]

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        if self.options.get("mode") != "log":
            raise ValueError("only mode=log can be streamed")
        return GitLogStream(self.options)
