"""Places in code: paths, lines, references to them in text, and names made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.text import basename, strip


def at_line(file: Column, line: Column) -> Column:
    """``file:line``, or the file alone without a line (0 is none)."""
    return F.when(F.coalesce(line, F.lit(0)) != 0, F.concat_ws(":", file, line.cast("string"))).otherwise(file)


def is_unsafe(path: Column) -> Column:
    """Whether a relative path is empty, absolute or climbs."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return path.isNull() | (path == "") | path.startswith("/") | path.startswith("\\") | path.rlike(r"^[A-Za-z]:") | F.array_contains(parts, "..")


def cited_files(text: Column, extensions: list[str]) -> Column:
    """The paths with one of the extensions that a text cites, sorted, each once."""
    alt = "|".join(sorted((e.lstrip(".") for e in extensions), key=lambda e: (-len(e), e)))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?U)([\w./-]+\.(?:{alt}))"), F.lit(1))))


def cited_lines(text: Column, files: Column) -> Column:
    """The line numbers that a text pins in files that it cites, sorted, each once."""
    pair = r"(?U)([\w./-]+\.\w+):(\d+)"
    paths, numbers = (F.regexp_extract_all(text, F.lit(pair), F.lit(g)) for g in (1, 2))
    names = F.transform(files, basename)
    pairs = F.arrays_zip(paths.alias("p"), numbers.alias("n"))
    own = F.filter(pairs, lambda x: F.array_contains(names, F.element_at(F.split(x["p"], "/"), -1)))
    lines = F.transform(own, lambda x: x["n"].try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.isNotNull())))


def control_ref(c: Column) -> Column:
    """A cited file without backticks and what follows a colon."""
    return strip(F.substring_index(F.replace(strip(c), F.lit("`"), F.lit("")), ":", 1))


def on_file(ref: Column, path: Column) -> Column:
    """Whether a cleaned reference means the path: as a whole if it has a slash, else by its name."""
    return F.when(F.contains(ref, F.lit("/")), ref == path).otherwise(ref == basename(path))


def chunk_path(chunk: Column) -> Column:
    """The file of one file's diff: the new name, else the old, else the header's; empty if none can be read."""

    def side(mark: str) -> Column:
        name = strip(F.regexp_extract(chunk, rf"(?m)^{mark} (.*)$", 1))
        plain = F.regexp_replace(name, "^[ab]/", "")
        return F.when((name != "") & (name != "/dev/null"), plain)

    header = strip(F.regexp_extract(chunk, r"(?m)^diff --git .*? b/(.*)$", 1))
    return F.coalesce(side(r"\+\+\+"), side("---"), header)


def changed_paths(diff: Column) -> Column:
    """The new names of the files that a diff touches, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1))))


def finding_slug(c: Column, most: int = 80) -> Column:
    """Letters and numbers in lower case, a hyphen for anything else, none at the ends; ``finding`` if nothing is left."""
    out = F.left(F.lower(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]", "-"), "^-+|-+$", "")), F.lit(most))
    return F.when(out == "", "finding").otherwise(out)


def unit_slug(path: Column) -> Column:
    """A unit's name from its path: without ``.py``, otherwise as in finding_slug but of any length."""
    plain = F.regexp_replace(F.translate(path, "\\", "/"), r"\.py$", "")
    return F.lower(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\p{L}\p{N}]", "-"), "^-+|-+$", ""))


def short_name(function: Column) -> Column:
    """A function's name without its parameters."""
    return F.substring_index(function, "(", 1)


def field(text: Column, key: str) -> Column:
    """The value of the first ``- key: value`` line, in any case; null without one."""
    found = F.regexp_extract(text, rf"(?im)^\s*-?\s*(?:{key})\s*:\s*(.+?)\s*$", 1)
    return F.nullif(found, F.lit(""))


def cited_place(text: Column) -> Column:
    """struct(file, line) of a location text such as ``path/x.py:12`` in backticks or not; the line is null without one."""
    pattern = r"(?U)`?([^\s`:()]+\.\w+)`?(?::(?:L)?(\d+))?"
    file = F.regexp_extract(text, pattern, 1)
    return F.struct(file.alias("file"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("line"))


def body(text: Column) -> Column:
    """A note from its first second-level heading on; empty without one."""
    return F.regexp_extract(text, r"(?ms)^## .*\z", 0)


def code_fence(text: Column) -> Column:
    """What stands in the first code fence; the text itself without one."""
    inside = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_+-]*\n(.*?)```", 1)
    return F.when(inside != "", inside).otherwise(text)


def table_rows(text: Column, header: str = "module") -> Column:
    """A markdown table's data rows as arrays of cells: no header (a row with the named cell), no rules."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x.startswith("|"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), strip))
    return F.filter(cells, lambda r: ~F.array_join(r, "").rlike("^[-:]*$") & ~F.exists(r, lambda c: F.lower(c) == header))
