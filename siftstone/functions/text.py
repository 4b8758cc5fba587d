"""Text helpers with Unicode white space and words, and file globs as regular expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with the value worked out once: in a lambda of an array function an outer expression is worked out for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def folded(c: Column) -> Column:
    """Stripped and in lower case; null as an empty text."""
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell pattern; ``*`` and ``?`` match ``/`` too."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        end = pattern.find("]", i + 1 + (pattern[i : i + 1] == "!")) if ch == "[" else -1
        if ch in "*?":
            out.append(".*" if ch == "*" else ".")
        elif end > 0:
            inside = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{inside[1:]}]" if inside.startswith("!") else f"[{chr(92) * inside.startswith('^')}{inside}]")
            i = end + 1
        else:
            out.append(f"\\{ch}" if not ch.isalnum() and ch != "_" and ord(ch) < 128 else ch)
    return f"(?s)^{''.join(out)}\\z"


def glob_regex_sql(c: Column) -> Column:
    """glob_regex of a column of patterns with ``*`` and ``?`` only."""
    quoted = F.regexp_replace(c, r"([^A-Za-z0-9_*?])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("\\z"))


def matches_glob(c: Column, patterns: list[str]) -> Column:
    """Whether any of the patterns matches; one expression for all."""
    if not patterns:
        return F.lit(False)
    return c.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def whole_token(text: Column, token: Column) -> Column:
    """Whether the token stands in the text with no word character next to it."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return F.rlike(text, quoted)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directories(path: Column) -> Column:
    """The path's directory segments; a backslash parts them too."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def suffix(path: Column) -> Column:
    """The last extension of the file name with its dot; none for a name that starts or ends with its only dot."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1)
