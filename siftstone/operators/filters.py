"""Path classes, finding filters and gates. Rules are data (``siftstone.sources.rules``); an unreadable path is kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions import severity
from siftstone.functions.location import at_line
from siftstone.functions.text import basename, directories, matches_glob, strip, suffix

Rules = Mapping[str, Sequence[str]]
FLOOR = 0.5


def _strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def is_skipped_dir(dirs: Column, rules: Rules) -> Column:
    """Whether any directory is one to skip, or the first is one to skip at the root."""
    first = F.get(dirs, F.lit(0))
    return F.arrays_overlap(dirs, _strings(rules["skip_dir"])) | F.coalesce(first.isin(*rules["skip_root_dir"]), F.lit(False))


def is_test_path(path: Column, rules: Rules) -> Column:
    """Whether the path is a test's, by a directory or the file name's form."""
    name = F.lower(basename(F.translate(path, "\\", "/")))
    return F.arrays_overlap(directories(path), _strings(rules["test_dir"])) | matches_glob(name, list(rules["test_name"]))


def is_noise(path: Column, rules: Rules) -> Column:
    """Whether the path can hold no code change that matters: skipped, a test, a lockfile or a document."""
    name = basename(F.translate(path, "\\", "/"))
    return is_skipped_dir(directories(path), rules) | is_test_path(path, rules) | name.isin(*rules["lockfile"]) | F.lower(suffix(name)).isin(*rules["doc_ext"])


def is_source(path: Column, rules: Rules) -> Column:
    return suffix(path).isin(*rules["source_ext"])


def in_inventory(path: Column, rules: Rules) -> Column:
    """Whether the path is a source file and no test's."""
    return is_source(path, rules) & ~is_test_path(path, rules)


def is_entrypoint(path: Column, text: Column, rules: Rules, globs: Sequence[str], markers: Sequence[str]) -> Column:
    """Whether a file may define entry points: by its path, or a source file by a marker in its text. Paths are tried first."""
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(text, F.lit(m))
    return ~is_test_path(path, rules) & (matches_glob(path, list(globs)) | (is_source(path, rules) & marked))


def is_public_api(path: Column, text: Column, rules: Rules, patterns: Sequence[str]) -> Column:
    """Whether a source file exports something, by line-wise patterns."""
    found = text.rlike("(?m)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)
    return in_inventory(path, rules) & found


def is_logic_layer(path: Column, rules: Rules, globs: Sequence[str]) -> Column:
    return ~is_test_path(path, rules) & matches_glob(path, list(globs))


def strip_noise(chunks: DataFrame, rules: Rules, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) chunks of a diff; one without a readable path is kept."""
    noise = F.coalesce(is_noise(F.col(path), rules) & (F.col(path) != ""), F.lit(False))
    marked = chunks.withColumn("_noise", noise)
    return marked.where("not _noise").drop("_noise"), marked.where("_noise").drop("_noise")


def drop_reason(rules: Rules, excluded: Sequence[str] = (), floor: float = FLOOR) -> Column:
    """Why a finding is dropped, by the first rule that holds; null if none does."""
    out = F.when(F.col("confidence") < floor, "low confidence").when(is_test_path(F.col("file"), rules), "test path")
    for part in excluded:
        out = out.when(F.contains("file", F.lit(part)), "excluded path")
    return out


def filter_findings(findings: DataFrame, rules: Rules, excluded: Sequence[str] = (), floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with ``reason``)."""
    marked = findings.withColumn("reason", drop_reason(rules, excluded, floor))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def dismissed(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Findings whose place or file isn't among the dismissed targets (column ``target``)."""
    names = targets.select(strip(F.col("target")).alias("target")).where("target <> ''").distinct()
    left = findings.withColumn("_place", at_line(F.col("file"), F.col("line"))).join(names, F.col("_place") == F.col("target"), "left_anti")
    return left.join(names, F.col("file") == F.col("target"), "left_anti").drop("_place")


def severity_gate(findings: DataFrame, threshold: str | None) -> DataFrame:
    """One row: whether any finding is as severe as the threshold; an unset or unknown threshold fails none."""
    level = (threshold or "").strip().upper()
    if level not in severity.LEVELS:
        return findings.agg(F.lit(False).alias("failed"))
    most = severity.LEVELS.index(level)
    return findings.agg(F.coalesce(F.max(severity.index(severity.normalize(F.col("severity"))) <= most), F.lit(False)).alias("failed"))


def rejected_candidate(place: Column, unsafe: Column, status: Column, title: Column) -> Column:
    """Whether an agent's candidate is none: no place, an unsafe one, or refuted or cleared."""
    state = F.lower(strip(F.coalesce(status, F.lit(""))))
    return place.isNull() | (place == "") | unsafe | state.startswith("refuted") | state.startswith("clear") | F.lower(strip(title)).startswith("cleared")


def select_items(items: DataFrame, tags: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """A suite's items: with one of the tags (all, if it names none), of one of the kinds (any, if it names none)."""
    out = items.where(F.arrays_overlap("tags", _strings(tags))) if tags else items
    return out.where(F.col("kind").isin(*kinds)) if kinds else out


#: The domains there are; a review of any other is an error, not an empty result.
DOMAINS = ("web", "evm")


def domain(name: str, paths: DataFrame | None = None) -> str:
    """A domain by its name, or by its files if the name is ``auto``; an unknown one raises ValueError."""
    chosen = domain_of(paths).first()["domain"] if name == "auto" and paths is not None else "web" if name == "auto" else name
    if chosen not in DOMAINS:
        raise ValueError(f"unknown domain {chosen}; there are {', '.join(DOMAINS)}")
    return chosen


def domain_of(paths: DataFrame, path: str = "path", group: Sequence[str] = ()) -> DataFrame:
    """``evm`` if there are contracts, and as many as other source files, else ``web``."""
    is_contract = F.lower(suffix(F.col(path))) == ".sol"
    contracts, others = F.count_if(is_contract), F.count_if(~is_contract)
    return paths.groupBy(*group).agg(F.when((contracts > 0) & (contracts >= others), "evm").otherwise("web").alias("domain"))
