"""Endpoints: a method and a path in many spellings, and whether two name one route."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.text import SPACE, folded, squeeze, strip

#: HTTP methods that start a route.
METHODS = ("get", "post", "put", "patch", "delete", "head", "options")

#: What goes, or is replaced, in an endpoint, in this order.
PATTERNS = ((r"(?U)\?\S*", ""), (r"\([^)]*\)", " "), (r"[<{][^>}]*[>}]", "*"))


def normalize(c: Column) -> Column:
    """In lower case, without backticks, query strings and remarks in parentheses; each parameter in <> or {} is ``*``."""
    text = F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit("`"), F.lit(""))
    for pattern, by in PATTERNS:
        text = F.regexp_replace(text, pattern, by)
    return squeeze(text)


def routes(c: Column) -> Column:
    """The routes of a normalized source line: parted by commas, and before a method; the line itself if there is none."""
    starts = rf"(?=\b(?:{'|'.join(METHODS)})\b\s)"
    parts = F.flatten(F.transform(F.split(c, r"\s*,\s*"), lambda p: F.split(p, starts)))
    found = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(c))


def method(c: Column) -> Column:
    """The first word if it is a method, else empty."""
    first = F.substring_index(c, " ", 1)
    return F.when(first.isin(*METHODS) & F.contains(c, F.lit(" ")), first).otherwise("")


def segments(c: Column) -> Column:
    """The parts of the path that aren't empty; the path is what follows the first space, if there is one."""
    at = F.locate(" ", c)
    path = F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(c)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def match_parts(m: Column, a: Column, n: Column, b: Column) -> Column:
    """match_one of methods m and n and segments a and b."""
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long = F.when(F.size(a) <= F.size(b), b).otherwise(a)
    tail = F.slice(long, -F.size(short), F.size(short))
    agree = ~F.exists(F.zip_with(short, tail, lambda x, y: (x != y) & (x != "*") & (y != "*")), lambda x: x)
    sized = (F.size(a) > 0) & (F.size(b) > 0)
    return ((m == "") | (n == "") | (m == n)) & sized & F.when(sized, (F.get(short, F.lit(0)) == F.get(tail, F.lit(0))) & agree).otherwise(False)


def match_one(route: Column, entry: Column) -> Column:
    """Whether two normalized routes agree: methods, and the shorter path with the end of the longer, ``*`` for any part but the first."""
    return match_parts(method(route), segments(route), method(entry), segments(entry))


def endpoint_match(report: Column, entry: Column) -> Column:
    """Whether any route of the report's source line is the entry's."""
    key = normalize(entry)
    return F.exists(routes(normalize(report)), lambda r: match_one(r, key))


def candidate_endpoint(c: Column) -> Column:
    """The endpoint as a candidate's key has it: parameters as ``*`` and white space squeezed, nothing else removed."""
    return F.regexp_replace(F.regexp_replace(folded(c), r"[<{][^>}]*[>}]", "*"), SPACE, " ")
