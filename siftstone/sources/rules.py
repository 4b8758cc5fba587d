"""Rules of path classes, as data: (kind, pattern) rows. Defaults cover common layouts; a project passes its own table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KINDS = ("skip_dir", "skip_root_dir", "source_ext", "config_ext", "manifest", "test_dir", "test_name", "doc_ext", "lockfile")
#: A default for each kind of rule.
DEFAULT: dict[str, list[str]] = {
    "skip_dir": [".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv"],
    "skip_root_dir": ["lib"],
    "source_ext": [".py", ".go", ".ts", ".tsx", ".js", ".java", ".rb", ".php", ".sol"],
    "config_ext": [".yaml", ".yml", ".toml", ".json"],
    "manifest": ["requirements.txt", "pyproject.toml", "package.json", "go.mod"],
    "test_dir": ["tests", "test", "__tests__", "testdata"],
    "test_name": ["test_*.py", "*_test.go", "*.test.ts", "*.spec.ts", "*.t.sol"],
    "doc_ext": [".md", ".rst", ".txt"],
    "lockfile": ["package-lock.json", "yarn.lock", "poetry.lock", "go.sum"],
}


def from_table(rules: DataFrame, limit: int = 10_000) -> dict[str, list[str]]:
    """Rules of a (kind, pattern) table; an unknown kind or too large a table raises."""
    rows = rules.select("kind", "pattern").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rules")
    out: dict[str, list[str]] = {k: [] for k in KINDS}
    for kind, pattern in sorted((r["kind"], r["pattern"]) for r in rows):
        if kind not in out:
            raise ValueError(f"unknown kind of rule: {kind}")
        out[kind].append(pattern)
    return out


def to_table(spark: SparkSession, rules: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(k, p) for k, ps in rules.items() for p in ps], "kind string, pattern string")


def detection_extensions(rules: dict[str, list[str]]) -> list[str]:
    """Extensions of files that are sampled to detect a stack: source and config."""
    return sorted({*rules["source_ext"], *rules["config_ext"]})
