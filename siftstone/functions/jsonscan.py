"""JSON objects in replies, and symbols in source text: scans with state, as Arrow-batched functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: characters of a reply that are scanned. What is beyond isn't read, so an object that ends there is none.
MAX_SCAN = 1_000_000
FENCE = re.compile(r"```(?:json)?\s*\n(.*?)```", re.S)
#: Words that declare a symbol.
DECLARES = ("function", "func", "def", "const", "let", "var", "class", "contract", "library", "interface", "modifier", "struct", "enum")
DECLARING, GIVEN, WORD = re.compile(rf"(?:{'|'.join(DECLARES)})\b"), re.compile(r"\s*[=(:]"), re.compile(r"\w")


def _loads(text: str) -> tuple[bool, object]:
    try:
        return True, json.loads(text)
    except ValueError:
        return False, None


def balanced_object(text: str) -> dict | None:
    """The first balanced {...} that is a JSON object. Braces in strings don't count; one jump a quote or brace."""
    depth, start, at = 0, 0, 0
    token = re.compile(r'["{}]')
    close = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
    while m := token.search(text, at):
        at = m.end()
        if m[0] == '"':
            ending = close.match(text, at)
            if ending is None:
                return None
            at = ending.end()
        elif m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                ok, found = _loads(text[start:at])
                if ok and isinstance(found, dict):
                    return found
    return None


def repaired(text: str) -> dict | None:
    """A small repair of a cut or sloppy reply: from its first brace, open strings and brackets closed, commas before an end dropped."""
    start = text.find("{")
    if start < 0:
        return None
    text, stack, in_string, escaped = text[start:], [], False, False
    for ch in text:
        if in_string:
            in_string, escaped = escaped or ch != '"', not escaped and ch == "\\"
        elif ch == '"':
            in_string = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif stack and ch == stack[-1]:
            stack.pop()
    text = (text + '"' * in_string).rstrip().rstrip(",:") + "".join(reversed(stack))
    ok, found = _loads(re.sub(r",\s*([}\]])", r"\1", text))
    return found if ok and isinstance(found, dict) else None


def extract_object(text: str | None) -> dict | None:
    """The JSON object of a reply: the reply itself, else in a fence, else the first balanced one, else repaired. Other JSON is none.

    Of a reply, its first ``MAX_SCAN`` characters are read.
    """
    text = (text or "").strip()[:MAX_SCAN]
    ok, found = _loads(text)
    if ok:
        return found if isinstance(found, dict) else None
    fence = FENCE.search(text)
    if fence:
        ok, found = _loads(fence[1])
        if ok and isinstance(found, dict):
            return found
    found = balanced_object(text)
    return found if found is not None else repaired(text)


@F.pandas_udf(T.StringType())
def json_object(reply: pd.Series) -> pd.Series:
    """The reply's JSON object as JSON text, null if there is none."""
    return reply.map(lambda x: None if (o := extract_object(x)) is None else json.dumps(o, ensure_ascii=False, separators=(",", ":")))


def declares(line: str, name: str) -> bool:
    """Whether the name, as whole words, stands after a declaring word or before ``=``, ``(`` or ``:``. No pattern is compiled for the name."""
    word = DECLARING.search(line)
    at = line.find(name)
    while at >= 0:
        end = at + len(name)
        if _bound(line, at) and _bound(line, end) and (word and word.end() <= at or GIVEN.match(line, end)):
            return True
        at = line.find(name, at + 1)
    return False


def _bound(line: str, at: int) -> bool:
    """Whether a word starts or ends at this place, as ``\\b`` tells it."""
    return (at > 0 and WORD.match(line, at - 1) is not None) != (WORD.match(line, at) is not None)


def symbol_span(text: str, symbol: str) -> tuple[int, int] | None:
    """The lines of a symbol's definition: to its closing brace, else to the next line not indented deeper."""
    lines, name = text.splitlines(), symbol.lower()
    first = next((i for i, line in enumerate(lines) if name in (low := line.lower()) and declares(low, name)), None)
    if first is None:
        return None
    depth, opened = 0, False
    for i in range(first, len(lines)):
        for brace in re.findall(r"[{}]", lines[i]):
            depth += 1 if brace == "{" else -1
            opened |= brace == "{"
            if opened and brace == "}" and depth == 0:
                return first + 1, i + 1
    if opened:
        return first + 1, len(lines)
    indent = lambda s: len(s) - len(s.lstrip())
    after = (i for i in range(first + 1, len(lines)) if lines[i].strip() and indent(lines[i]) <= indent(lines[first]))
    return first + 1, next(after, len(lines))


@F.pandas_udf(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
def symbol_lines(text: pd.Series, symbol: pd.Series) -> pd.DataFrame:
    """The lines of a symbol's definition in a source text, nulls if it isn't found."""
    spans = [symbol_span(t or "", s or "") if s else None for t, s in zip(text, symbol, strict=True)]
    return pd.DataFrame([s or (None, None) for s in spans], columns=["first", "last"], dtype="Int32")
