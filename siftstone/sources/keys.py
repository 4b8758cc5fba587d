"""Answer keys, cases and benchmarks: strict tables. What is broken raises when the check runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions.text import strip

KEY = "target string, kind string, seq int, id string, entry string, files array<string>, category string, severity string, note string, knowledge array<string>, symbols array<string>"
CASE = "name string, diff string, category string, knowledge array<string>, tags array<string>, domain string"


def _list(value: object) -> list[str]:
    return [] if value in (None, "") else [str(value)] if isinstance(value, str) else [str(v) for v in value]  # type: ignore[union-attr]


def answer_key(spark: SparkSession, data: dict) -> DataFrame:
    """An answer key's rows from loaded YAML or JSON: ``planted`` (or the older ``issues``) and ``safe`` lists.

    A key without a planted list, or an entry without an id or a location (entry, file or files), raises ValueError.
    """
    planted = data.get("planted", data.get("issues"))
    if not isinstance(planted, list):
        raise ValueError("an answer key needs a planted list")
    rows = []
    for kind, entries in (("planted", planted), ("safe", data.get("safe") or [])):
        for i, e in enumerate(entries):
            files, symbols = _list(e.get("files") or e.get("file")), _list(e.get("symbols") or e.get("symbol"))
            if not e.get("id"):
                raise ValueError(f"{kind} entry {i} has no id")
            if not (e.get("entry") or files):
                raise ValueError(f"{kind} entry {e['id']} has no location")
            rows.append((str(data.get("target", "")), kind, i, str(e["id"]), e.get("entry") or "", files, e.get("category") or "", e.get("severity") or "", e.get("note") or "", _list(e.get("knowledge")), [s.strip().lower() for s in symbols]))
    return spark.createDataFrame(rows, KEY)


def diff_cases(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """Diff cases; one without a diff, or two of a name, raise ValueError; the domain is web if unset."""
    seen: set[str] = set()
    rows = []
    for c in cases:
        if not c.get("diff"):
            raise ValueError(f"case {c.get('name')} has no diff")
        if c["name"] in seen:
            raise ValueError(f"two cases are named {c['name']}")
        seen.add(c["name"])
        rows.append((c["name"], c["diff"], c.get("category") or "", _list(c.get("knowledge")), _list(c.get("tags")), c.get("domain") or "web"))
    return spark.createDataFrame(rows, CASE)


_ENTRY = "array<struct<id:string,entry:string,file:string,files:array<string>,category:string,severity:string,note:string,knowledge:array<string>,symbol:string,symbols:array<string>>>"


def answer_keys(texts: DataFrame) -> DataFrame:
    """Answer key rows of JSON texts (target, text), strict: a row raises when it is read if its key has no planted list, or it has no id or no location."""
    x = F.from_json("text", f"planted {_ENTRY}, issues {_ENTRY}, safe {_ENTRY}")
    planted = F.coalesce(x["planted"], x["issues"])
    lists = texts.select("target", F.when(planted.isNull(), F.raise_error(F.lit("an answer key needs a planted list")).cast(_ENTRY)).otherwise(planted).alias("planted"), F.coalesce(x["safe"], F.array().cast(_ENTRY)).alias("safe"))
    rows = reduce(DataFrame.unionByName, (lists.select("target", F.lit(kind).alias("kind"), F.posexplode(kind).alias("seq", "e")) for kind in ("planted", "safe")))
    text = lambda n: F.coalesce(F.col(f"e.{n}"), F.lit(""))
    many = lambda some, one: F.when(F.size(F.col(f"e.{some}")) > 0, F.col(f"e.{some}")).when(text(one) != "", F.array(text(one))).otherwise(F.array().cast("array<string>"))
    files = many("files", "file")
    why = F.when(text("id") == "", "an entry has no id").when((text("entry") == "") & (F.size(files) == 0), "an entry has no location")
    id_ = F.when(why.isNotNull(), F.raise_error(why).cast("string")).otherwise(text("id"))
    symbols = F.transform(many("symbols", "symbol"), lambda s: F.lower(strip(s)))
    return rows.select("target", "kind", "seq", id_.alias("id"), text("entry").alias("entry"), files.alias("files"), text("category").alias("category"), text("severity").alias("severity"), text("note").alias("note"), F.coalesce("e.knowledge", F.array().cast("array<string>")).alias("knowledge"), symbols.alias("symbols"))


def cases(texts: DataFrame) -> DataFrame:
    """Diff cases of JSON texts (text), strict: one without a diff raises when it is read; two of a name raise at once."""
    x = F.from_json("text", "name string, diff string, category string, knowledge array<string>, tags array<string>, domain string")
    none = F.array().cast("array<string>")
    diff = F.when(F.coalesce(F.col("x.diff"), F.lit("")) == "", F.raise_error(F.lit("a case has no diff")).cast("string")).otherwise(F.col("x.diff"))
    rows = texts.select(x.alias("x")).select("x.name", diff.alias("diff"), F.coalesce("x.category", F.lit("")).alias("category"), F.coalesce("x.knowledge", none).alias("knowledge"), F.coalesce("x.tags", none).alias("tags"), F.coalesce(F.nullif("x.domain", F.lit("")), F.lit("web")).alias("domain"))
    return unique(rows, ["name"], "a case")


def unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, whose rows raise if two share the keys; the count is made with the rows, not before."""
    clash = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1)
    if clash.count():
        raise ValueError(f"{what} is there twice: {clash.first().asDict()}")
    return df


def merged_benchmarks(roots: list[tuple[int, DataFrame, bool]]) -> DataFrame:
    """Benchmarks (id, ...) of roots (order, table, may override): the last root's row of an id; a clash without override raises."""
    out = roots[0][1].withColumn("_root", F.lit(roots[0][0]))
    for order, table, override in roots[1:]:
        if not override:
            clash = table.join(out, "id", "left_semi").limit(1).count()
            if clash:
                raise ValueError("a benchmark is defined in two roots")
        out = out.unionByName(table.withColumn("_root", F.lit(order)))
    names = [c for c in out.columns if c not in ("id", "_root")]
    return out.groupBy("id").agg(F.max_by(F.struct(*names), "_root").alias("_row")).select("id", *(F.col(f"_row.{c}").alias(c) for c in names))


def entry_schema() -> T.StructType:
    return T.StructType.fromDDL(KEY)


def suite(suites: DataFrame, name: str) -> dict:
    """A suite's tags and kinds; an unknown name raises ValueError."""
    row = suites.where(F.col("name") == name).first()
    if row is None:
        raise ValueError(f"unknown suite {name}")
    return row.asDict()


def suites_of(asked: DataFrame, suites: DataFrame) -> DataFrame:
    """asked (with suite, a name) with the columns of its suite; an unknown name raises when its row is read."""
    known = suites.withColumn("_known", F.lit(True))
    joined = asked.join(known, F.col("suite") == F.col("name"), "left")
    name = F.when(F.col("_known"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("unknown suite "), F.coalesce("suite", F.lit("")))).cast("string"))
    return joined.withColumn("name", name).drop("_known")


def knowledge_items(docs: DataFrame) -> DataFrame:
    """(ref, kind) of knowledge files (ref, kind, path); a ref of two paths raises ValueError."""
    return unique(docs.select("ref", "kind", "path").distinct(), ["ref"], "a ref").select("ref", "kind")
