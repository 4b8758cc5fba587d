"""Verified-source payloads in their three shapes, and provenance fields."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftstone.functions.location import is_unsafe
from siftstone.functions.text import strip
from siftstone.sources import formats

#: Explorer chain names and their ids.
CHAINS = {"ethereum": 1, "bsc": 56, "polygon": 137, "arbitrum": 42161}


def source_files(code: str, name: str) -> dict[str, str]:
    """Paths and contents of a payload: a doubly braced JSON, a JSON with ``sources`` or of paths, or one plain source."""
    text = (code or "").strip()
    if text.startswith("{{") and text.endswith("}}"):
        text = text[1:-1]
    if not text.startswith("{"):
        return {f"{name}.sol": code} if text else {}
    data = json.loads(text)
    found = data.get("sources", data)
    out = {p: v if isinstance(v, str) else v.get("content", "") for p, v in found.items()}
    return {safe_path(p): c for p, c in out.items()}


def safe_path(path: str) -> str:
    """A path with slashes; one that is absolute, has a drive or climbs raises ValueError."""
    plain = path.replace("\\", "/")
    if plain.startswith("/") or plain[1:2] == ":" or ".." in plain.split("/") or not plain:
        raise ValueError(f"unsafe path {path}")
    return plain


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])))
def _files(code: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([[{"path": p, "text": c} for p, c in sorted(source_files(x, n).items())] for x, n in zip(code, name, strict=True)])


def reconstructed(payloads: DataFrame) -> DataFrame:
    """(address, path, text) of payloads (address, contract_name, source_code)."""
    return payloads.select("address", F.explode(_files("source_code", "contract_name")).alias("f")).select("address", "f.path", "f.text")


RESPONSE = "status string, message string, result array<struct<SourceCode:string,ContractName:string,CompilerVersion:string,OptimizationUsed:string,Runs:string,EVMVersion:string,Proxy:string,Implementation:string>>"


def checked(responses: DataFrame) -> DataFrame:
    """(address, contract_name, ..., source_code) of explorer responses (address, payload); a row raises when it is read if its response is no object, an error, without a result or not verified."""
    x = F.from_json("payload", RESPONSE)
    first = F.get(x["result"], F.lit(0))
    detail = F.coalesce(F.get_json_object("payload", "$.result"), x["message"], F.lit("unknown error"))
    why = F.when(x.isNull() | ~strip(F.col("payload")).startswith("{"), "the response is no JSON object").when(strip(x["status"]) == "0", F.concat(F.lit("explorer error: "), detail))
    why = why.when(x["result"].isNull() | (F.size(x["result"]) == 0) | first.isNull(), "the response has no source").when(strip(F.coalesce(first["SourceCode"], F.lit(""))) == "", "the source is not verified")
    entry = responses.select("address", F.when(why.isNotNull(), F.raise_error(why).cast(f"struct<{RESPONSE.split('struct<')[1][:-1]}")).otherwise(first).alias("e"))
    names = {"contract_name": "ContractName", "compiler_version": "CompilerVersion", "optimization_used": "OptimizationUsed", "runs": "Runs", "evm_version": "EVMVersion", "proxy": "Proxy", "implementation": "Implementation", "source_code": "SourceCode"}
    return entry.select("address", *(F.coalesce(F.col(f"e.{old}"), F.lit("")).alias(new) for new, old in names.items()))


def provenance(spark: SparkSession, path: str, schema: str = "address string, contract_name string, compiler_version string, optimization_used string, runs string, evm_version string, proxy string, implementation string") -> DataFrame | None:
    """Provenance stored as JSON: None if there is none or all of it is empty; what is malformed raises."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    meta = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)
    rows = meta.where(~is_blank(meta) | (F.coalesce("address", F.lit("")) != ""))
    return None if rows.isEmpty() else rows


def write_tree(files: DataFrame, root: str) -> int:
    """Write (path, text) rows as files below a folder, by the tasks; a path that isn't relative and safe raises before any is written."""
    bad = files.where(is_unsafe(F.col("path"))).limit(1).collect()
    if bad:
        raise ValueError(f"unsafe path {bad[0]['path']}")
    formats.write_tree(files, root)
    return files.count()


def flag(c: Column) -> Column:
    """``1`` and ``0`` as a boolean, else null."""
    return F.when(c == "1", True).when(c == "0", False)


def metadata(payloads: DataFrame) -> DataFrame:
    """Typed provenance of raw explorer fields: text that isn't a number or flag becomes null."""
    return payloads.select("address", "contract_name", "compiler_version", flag(F.col("optimization_used")).alias("optimization_used"), F.col("runs").try_cast("int").alias("runs"), F.nullif("evm_version", F.lit("")).alias("evm_version"), flag(F.col("proxy")).alias("proxy"), F.nullif("implementation", F.lit("")).alias("implementation_address"))


def provenance_rows(meta: DataFrame) -> DataFrame:
    """(address, field, value) of the fields that aren't empty, as text."""
    names = [c for c in meta.columns if c != "address"]
    rows = meta.select("address", *(F.col(c).cast("string").alias(c) for c in names)).unpivot("address", names, "field", "value")
    return rows.where("value is not null and value <> ''")


def chain_id(name: str) -> int:
    """A chain's id; an unknown chain raises ValueError."""
    if name not in CHAINS:
        raise ValueError(f"unknown chain {name}; there are {', '.join(CHAINS)}")
    return CHAINS[name]


def chain_of(name: Column) -> Column:
    """A chain's id by its name; an unknown name raises when its row is read."""
    out = F.raise_error(F.concat(F.lit("unknown chain "), F.coalesce(name, F.lit("")))).cast("int")
    for chain, number in CHAINS.items():
        out = F.when(name == chain, number).otherwise(out)
    return out


def is_blank(meta: DataFrame) -> Column:
    """Whether all fields of a provenance row but its address are empty."""
    names = [c for c in meta.columns if c != "address"]
    blank = F.lit(True)
    for c in names:
        blank = blank & (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return blank
