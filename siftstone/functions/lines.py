"""Lines and windows of texts, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, OVERLAP = 24_000, 2_000


def numbered(text: Column, first: Column | int = 1) -> Column:
    """Each line after its number, right-aligned to the last one's width."""
    first = F.lit(first) if isinstance(first, int) else first
    lines = F.split(text, "\n")
    width = F.length((first + F.size(lines) - 1).cast("string"))
    return F.array_join(F.transform(lines, lambda line, i: F.concat(F.lpad((i + first).cast("string"), width, F.lit(" ")), F.lit(" | "), line)), "\n")


def line_at(text: Column, offset: Column) -> Column:
    """The number of the line that a character offset lies in, from 1."""
    return F.regexp_count(F.left(text, offset), F.lit("\n")) + 1


def span_lines(text: Column, start: Column, end: Column) -> Column:
    """struct(first, last): the lines that characters start to end - 1 lie in."""
    return F.struct(line_at(text, start).alias("first"), line_at(text, F.greatest(start, end - 1)).alias("last"))


#: Lines that are folded at a time.
BLOCK = 256


def boundaries(text: Column) -> Column:
    """Offsets of lines that begin with a character that isn't white space, ascending.

    Lines are folded in blocks, whose offsets are then put end to end, so a step copies a block's offsets, not a text's.
    """
    lines = F.split(text, "\n")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / BLOCK).cast("int")), lambda i: F.slice(lines, i * BLOCK + 1, F.lit(BLOCK)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        out = F.when(line.rlike(r"(?U)^\S"), F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), out.alias("out"))

    def join(acc: Column, block: Column) -> Column:
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.transform(block["out"], lambda x: x + acc["at"])).alias("out"))

    return F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, zero, step)), zero, join)["out"]


def windows(length: Column, starts: Column, window: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """Spans (start, end) that cover a text of the length: one if it fits; else each ends at the last start within the window, or is cut with an overlap.

    A step moves on by ``window - overlap`` characters or to the last start within the window, so the steps tried are
    as many as the boundaries and the cuts together.
    """
    state = "struct<at:int,done:boolean,out:array<struct<start:int,end:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,end:int>>").alias("out")).cast(state)

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        target = at + window
        inside = F.array_max(F.filter(starts, lambda b: (b > at) & (b <= target)))
        end = F.when(target >= length, length).otherwise(F.coalesce(inside, target)).cast("int")
        following = F.when(inside.isNotNull(), inside).otherwise(target - overlap).cast("int")
        more = F.struct(F.when(target >= length, at).otherwise(following).alias("at"), (target >= length).alias("done"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end")))).alias("out")).cast(state)
        return F.when(acc["done"], acc).otherwise(more)

    most = (F.size(starts) + F.ceil(length / (window - overlap)) + 1).cast("int")
    split = F.aggregate(F.sequence(F.lit(1), most), zero, step)["out"]
    whole = F.array(F.struct(F.lit(0).alias("start"), length.cast("int").alias("end")))
    return F.when(length <= window, whole).otherwise(split)
