"""Column expressions on path text. Everything here stays inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path fragments that mark transient data.
TRASH_MARK = "/.Trash/"
TRANSIENT_MARKS = ("/.Trash/", "/_temporary/", "/_distcp_logs_")


def as_column(value: Column | str) -> Column:
    """Strings name columns, as in pyspark.sql.functions."""
    return F.col(value) if isinstance(value, str) else value


def is_trash(path: Column | str) -> Column:
    return as_column(path).contains(TRASH_MARK)


def is_transient(path: Column | str) -> Column:
    path = as_column(path)
    hit = path.contains(TRANSIENT_MARKS[0])
    for mark in TRANSIENT_MARKS[1:]:
        hit = hit | path.contains(mark)
    return hit


def protected(path: Column | str) -> Column:
    """Home roots that a source delete must never touch.

    The prefix is bare on purpose: `/username` counts as protected too.
    """
    path = as_column(path)
    levels = F.size(F.split(F.rtrim(path, F.lit("/")), "/"))
    return path.startswith("/user") & (
        (levels == 3) | ((levels == 4) & path.endswith(".Trash"))
    )


def is_file(permission: Column | str) -> Column:
    return as_column(permission).startswith("-")


def squeeze(path: Column | str) -> Column:
    """Runs of slashes become one; the pair after a scheme's colon stays."""
    return F.regexp_replace(as_column(path), "(?<!:)/{2,}", "/")


def parent(path: Column | str) -> Column:
    path = as_column(path)
    length = F.char_length(path) - F.char_length(base_name(path)) - 1
    return F.when(length <= 0, F.lit("/")).otherwise(F.substring(path, F.lit(1), length))


def base_name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def lineage(path: Column | str) -> Column:
    """All ancestors of a path from the top down, the path itself last."""
    parts = F.split(F.rtrim(as_column(path), F.lit("/")), "/")
    joined = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda depth: F.array_join(F.slice(parts, F.lit(1), depth), "/"),
    )
    return F.transform(joined, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def ancestors(path: Column | str) -> Column:
    """Strict ancestors of a path from the top down."""
    whole = lineage(path)
    return F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0)))


def target_path(root: str, path: Column | str) -> Column:
    return squeeze(F.concat(F.lit(root), as_column(path)))


def bare_path(path: Column | str) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(as_column(path), "^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "")


def trash_path(root: str, day: Column | str, path: Column | str) -> Column:
    """root / yyyyMMdd / absolute parent / name, without scheme and host; `day` is literal text or a column."""
    day = F.lit(day) if isinstance(day, str) else day
    return squeeze(F.concat_ws("/", F.lit(root), day, bare_path(path)))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression for one file-system glob.

    `*` and `?` stay inside one path level; `[..]`, `[^..]`, `{a,b}` and
    backslash escapes have their usual file-system meaning.
    """
    wild = {"*": "[^/]*", "?": "[^/]"}
    out, braces, at = [], 0, 0
    while at < len(pattern):
        ch = pattern[at]
        if ch == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        elif ch in wild:
            out.append(wild[ch])
        elif ch == "[" and "]" in pattern[at + 2 :]:
            end = pattern.index("]", at + 2)
            inner = pattern[at + 1 : end]
            negated = inner[:1] in ("!", "^")
            body = inner[1:] if negated else inner
            body = body.replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&")
            out.append(f"[^/{body}]" if negated else f"[{body}]")
            at = end
        elif ch == "{":
            braces += 1
            out.append("(?:")
        elif ch == "}" and braces:
            braces -= 1
            out.append(")")
        elif ch == "," and braces:
            out.append("|")
        else:
            out.append(re.escape(ch))
        at += 1
    if braces:
        raise ValueError(f"unclosed brace in glob: {pattern}")
    return f"^(?:{''.join(out)})$"


def glob_prefix(pattern: str) -> str:
    """Literal text every match starts with; a prefix filter can be pushed to a scan."""
    return re.match(r"[^*?\[{\\]*", pattern).group(0)


def glob_match(path: Column | str, pattern: str) -> Column:
    path = as_column(path)
    hit = path.rlike(glob_regex(pattern))
    prefix = glob_prefix(pattern)
    return path.startswith(prefix) & hit if prefix else hit


def partition_value(path: Column | str, key: str, strict: bool = True) -> Column:
    """Value of `key` in `k1=v1/k2=v2`, null when absent.

    Strict asks for a whole key. Loose takes the first `key=` anywhere, so
    `date` also finds `logdate=`.
    """
    left = "(?<![^/])" if strict else ""
    found = F.regexp_extract(as_column(path), f"{left}{re.escape(key)}=[^/]*", 0)
    return F.substring(F.nullif(found, F.lit("")), F.lit(len(key) + 2), F.char_length(found))


def partition_values(path: Column | str) -> Column:
    """Ordered values of a partition text."""
    parts = F.split(as_column(path), "/")
    return F.transform(parts, lambda part: F.get(F.split(part, "="), 1))


def parse_values(text: str) -> list[str]:
    """Values of a partition given as `v1 / v2`; empty ones at the end are dropped."""
    values = re.split(r"\s*/\s*", text)
    while len(values) > 1 and not values[-1]:
        values.pop()
    return values
