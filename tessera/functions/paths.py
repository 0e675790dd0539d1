"""Expressions on repository paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Slashes for backslashes, one leading ``./`` removed; letter case is kept."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def package_of(path: Column) -> Column:
    """The directory part, '' for a file at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def module_name(path: Column) -> Column:
    """Dotted module for Python, extension-less path for the other languages."""
    dotted = F.translate(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
    return F.when(path.endswith(".py"), dotted).otherwise(F.regexp_replace(path, r"\.[^./]*$", ""))
