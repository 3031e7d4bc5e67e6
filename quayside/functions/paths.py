"""Path and name functions as plain Spark columns."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    """Last path element; trailing slashes are ignored, '' gives '.' and '/' gives '/'."""
    p = _col(path)
    trimmed = F.rtrim(p, F.lit("/"))
    return (
        F.when(p == "", ".")
        .when(trimmed == "", "/")
        .otherwise(F.substring_index(trimmed, "/", -1))
    )


def clean(path: Column | str) -> Column:
    """Lexically shortest equivalent path: folds '', '.', '..' and repeated slashes."""
    p = _col(path)
    rooted = p.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        parent = F.regexp_replace(acc, r"(^|/)[^/]*\z", "")
        climbs = (acc == "..") | acc.endswith("/..")
        appended = F.when(acc == "", part).otherwise(F.concat(acc, F.lit("/"), part))
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & rooted, parent)
            .when((part == "..") & ((acc == "") | climbs), appended)
            .when(part == "..", parent)
            .otherwise(appended)
        )

    body = F.aggregate(F.split(p, "/"), F.lit(""), step)
    return F.when(rooted, F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def dirname(path: Column | str) -> Column:
    """Everything up to the last slash, cleaned; no slash gives '.'."""
    return clean(F.regexp_replace(_col(path), r"[^/]*\z", ""))


def parent(path: Column | str) -> Column:
    """Directory of an absolute path that is already clean, such as any listed one; no lambda involved."""
    up = F.regexp_replace(_col(path), r"/[^/]*\z", "")
    return F.when(up == "", "/").otherwise(up)


def under(directory: str, name: Column | str) -> Column:
    """A base name placed below a fixed directory."""
    return F.concat(F.lit(posixpath.normpath(directory).rstrip("/") + "/"), _col(name))


def join(*parts: Column | str) -> Column:
    """Join non-empty elements (plain strings are literals) with '/' and clean the result."""
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    glued = F.concat_ws("/", *[F.when(c != "", c) for c in cols])
    return F.when(glued == "", "").otherwise(clean(glued))


def ext(name: Column | str) -> Column:
    """From the last dot of the last element, dot included; '' without a dot."""
    return F.regexp_extract(_col(name), r"(\.[^./]*)\z", 1)


def kind(name: Column | str) -> Column:
    """Lower-case extension without the dot; names without one are 'unknown'."""
    e = F.lower(ext(name))
    return F.when(e == "", "unknown").otherwise(F.substring(e, 2, 2**31 - 1))


def is_archive(name: Column | str) -> Column:
    return F.lower(ext(name)) == ".zip"


def is_inside(path: Column | str, directory: Column | str) -> Column:
    """True when the cleaned path lies strictly below the cleaned directory."""
    d = clean(directory)
    return clean(path).startswith(F.when(d == "/", "/").otherwise(F.concat(d, F.lit("/"))))


def ancestors(path: Column | str) -> Column:
    """All proper ancestor directories of an absolute, clean path, without the root."""
    parts = F.split(F.substring(_col(path), 2, 2**31 - 1), "/")
    depth = F.size(parts) - 1
    return F.when(
        depth >= 1,
        F.transform(
            F.sequence(F.lit(1), depth),
            lambda i: F.concat(F.lit("/"), F.concat_ws("/", F.slice(parts, F.lit(1), i))),
        ),
    ).otherwise(F.array().cast("array<string>"))
