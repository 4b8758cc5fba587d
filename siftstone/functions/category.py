"""Category names: slugs, aliases and the loose comparison of two names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import strip

#: The category that a free text means, by the first of its marks found in it; in this order.
HINTS = {
    "insecure-direct-object-reference": ("idor", "direct object", "insecure-direct"),
    "missing-authorization": ("missing auth", "authorization", "authz", "access control", "broken access"),
    "replay-attack": ("replay",),
    "mass-assignment": ("mass assignment", "mass-assignment"),
    "auth-bypass": ("auth bypass", "authentication bypass"),
    "accounting-precision": ("accounting", "rounding"),
    "xml-external-entity": ("xxe", "xml external entity"),
    "cross-site-request-forgery": ("csrf", "cross-site request forgery", "cross site request forgery"),
}
OTHER = "other"


def slug(c: Column) -> Column:
    """Stripped, in lower case, with a hyphen for each space or underscore."""
    return F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), "_ ", "--")


def category_of(c: Column) -> Column:
    """The category that a free text names."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    plain = F.regexp_replace(F.regexp_replace(text, r"(?U)[\s_]+", "-"), "^-+|-+$", "")
    hit = lambda marks: reduce(Column.__or__, (F.contains(text, F.lit(m)) for m in marks))
    return reduce(lambda out, kv: F.when(hit(kv[1]), kv[0]).otherwise(out), reversed(HINTS.items()), plain)


def category_match(a: Column, b: Column) -> Column:
    """Whether one's hyphen-parted words are all among the other's; an empty category matches none."""
    x, y = F.split(a, "-"), F.split(b, "-")
    return (a != "") & (b != "") & ((a == b) | (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def normalized(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """df with the column's slug where it is a known id (column ``id``), ``other`` where it isn't; empty stays empty."""
    ids = known.select(F.col("id").alias("_known")).distinct()
    out = df.withColumn("_slug", slug(F.col(column))).join(ids, F.col("_slug") == F.col("_known"), "left")
    value = F.when(F.col("_slug") == "", "").when(F.col("_known").isNull(), OTHER).otherwise(F.col("_slug"))
    return out.withColumn(column, value).drop("_slug", "_known")


def alias_map(classes: DataFrame) -> DataFrame:
    """(alias, id): each class's id and aliases as slugs; of classes that claim one alias the last by id has it."""
    own = F.array(F.col("id"))
    rows = classes.select("id", F.explode(F.concat(own, F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    return rows.select(slug(F.col("alias")).alias("alias"), "id").groupBy("alias").agg(F.max("id").alias("id"))


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with the column's slug replaced by the id that it is an alias of; an unknown one stays."""
    names = aliases.select(F.col("alias").alias("_alias"), F.col("id").alias("_id"))
    return df.withColumn("_slug", slug(F.col(column))).join(names, F.col("_slug") == F.col("_alias"), "left").withColumn(column, F.coalesce("_id", "_slug")).drop("_slug", "_alias", "_id")
