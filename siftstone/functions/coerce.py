"""Loosely structured findings as typed columns: nothing raises, each bad field gets its default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions import severity
from siftstone.functions.location import is_unsafe
from siftstone.functions.text import strip

CONFIDENCE = 0.5
#: A number as JSON and float() agree on it.
NUMBER = r"^\s*[+-]?(\d+(_?\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: JSON of one finding: numbers are read as text, so that each can be judged for itself.
FINDING = "file string, line int, severity string, category string, description string, exploit_scenario string, recommendation string, confidence string"
CANDIDATE = "title string, description string, category string, endpoint string, symbol string, file string, line int, severity string, evidence string"


def to_float(c: Column, default: float = CONFIDENCE) -> Column:
    """A number from 0 to 1 in a text, else the default; ``true`` is no number."""
    value = F.when(c.rlike(NUMBER), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("double"))
    return F.coalesce(F.when(value.between(0.0, 1.0), value), F.lit(default))


def to_line(c: Column) -> Column:
    """A line number of 1 or more, else null."""
    return F.when(c >= 1, c)


def findings(reply: Column) -> Column:
    """The findings of a reply ``{"findings": [...]}`` as structs; null if there is no such list. Those without a file are dropped."""
    raw = F.from_json(reply, f"findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")["findings"]
    text = lambda c: F.coalesce(c, F.lit(""))
    typed = F.transform(raw, lambda x: F.struct(text(x["file"]).alias("file"), to_line(x["line"]).alias("line"), severity.exact(x["severity"]).alias("severity"), text(x["category"]).alias("category"), text(x["description"]).alias("description"), text(x["exploit_scenario"]).alias("exploit_scenario"), text(x["recommendation"]).alias("recommendation"), to_float(x["confidence"]).alias("confidence")))
    return F.filter(typed, lambda x: strip(x["file"]) != "")


def candidates(reply: Column) -> Column:
    """The candidates of a reply ``{"findings": [...]}``: an unsafe file becomes empty, the row stays; rows without any title go."""
    raw = F.from_json(reply, f"findings array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>>")["findings"]
    text = lambda c: F.coalesce(c, F.lit(""))

    def typed(x: Column) -> Column:
        title = F.when(strip(text(x["title"])) != "", x["title"]).otherwise(text(x["description"]))
        file = F.when(is_unsafe(text(x["file"])), "").otherwise(text(x["file"]))
        level = F.when(text(x["severity"]) == "", "HIGH").otherwise(severity.normalize(x["severity"]))
        return F.struct(title.alias("title"), text(x["category"]).alias("category"), text(x["endpoint"]).alias("endpoint"), text(x["symbol"]).alias("symbol"), file.alias("file"), to_line(x["line"]).alias("line"), level.alias("severity"), text(x["evidence"]).alias("evidence"))

    return F.filter(F.transform(raw, typed), lambda x: strip(x["title"]) != "")
