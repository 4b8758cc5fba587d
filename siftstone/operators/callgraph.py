"""Call-path units: risky functions with their neighbours, packed under a cap; contained units dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.location import short_name
from siftstone.session import checkpointed

CAP = 16_000
#: Before every place among calls: where a call has none.
FIRST = -(1 << 63)


def neighbours(functions: DataFrame, calls: DataFrame, risky: Column) -> DataFrame:
    """(contract, anchor, fn, hop, seq, size): each risky function, what it calls, and what calls it, in the same contract; once each."""
    sized = functions.where(F.col("start").isNotNull() & F.col("end").isNotNull()).withColumn("size", F.col("end") - F.col("start")).withColumn("_risky", risky)
    heads = sized.where("_risky").select("contract", F.col("fn").alias("anchor")).distinct()
    # a call is read once and told to both of its ends; keys begin with what tells rows apart, which is what a sort looks at first
    end = lambda anchor, fn, hop: F.struct(F.col(anchor).alias("anchor"), F.col(fn).alias("fn"), F.lit(hop).alias("hop"), F.coalesce(F.col("seq").cast("long"), F.lit(FIRST)).alias("seq"))
    told = calls.select("contract", F.explode(F.array(end("caller", "callee", 1), end("callee", "caller", 2))).alias("x")).select("contract", "x.*")
    met = told.where("fn <> anchor").join(heads.hint("shuffle_hash"), ["anchor", "contract"], "left_semi")
    least = lambda hop: F.min(F.when(F.col("hop") == hop, F.col("seq")))
    first = met.groupBy("anchor", "contract", "fn").agg(least(1).alias("_callee"), least(2).alias("_caller"))
    called = F.col("_callee").isNotNull()
    near = first.select("contract", "anchor", "fn", F.when(called, 1).otherwise(2).alias("hop"), F.nullif(F.coalesce("_callee", "_caller"), F.lit(FIRST)).alias("seq"))
    own = heads.select("contract", "anchor", F.col("anchor").alias("fn"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("seq"))
    placed = own.unionByName(near).join(sized.select("contract", "fn", "file", "start", "end", "size"), ["fn", "contract"])
    return placed.select("contract", "fn", "anchor", "hop", "seq", "file", "start", "end", "size")


def call_path_units(functions: DataFrame, calls: DataFrame, risky: Column, cap: int = CAP) -> DataFrame:
    """One row an anchor: the functions that fit the cap, tried anchor first, then callees, then callers; one that doesn't fit is passed over.

    The fold runs over the neighbours of one function that can have a place: once one of a size doesn't fit, no later
    one of that size does, so of each size the first ``cap / size`` are enough, however many callers a function has.
    """
    order = Window.partitionBy("anchor", "contract", "size").orderBy("hop", "seq", "fn")
    rows = neighbours(functions, calls, risky).withColumn("_n", F.row_number().over(order)).where((F.col("hop") == 0) | (F.col("size") <= 0) | (F.col("_n") <= F.floor(F.lit(cap) / F.col("size")))).drop("_n")
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<string>").alias("fns"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["fns"]) == 0) | (acc["sum"] + x["size"] <= cap)
        return F.when(fits, F.struct((acc["sum"] + x["size"]).alias("sum"), F.concat(acc["fns"], F.array(x["fn"])).alias("fns"))).otherwise(acc)

    ordered = F.array_sort(F.collect_list(F.struct("hop", "seq", "fn", F.col("size").cast("bigint").alias("size"))))
    units = rows.groupBy("anchor", "contract").agg(ordered.alias("xs"), F.min("file").alias("file")).select("contract", "anchor", "file", F.aggregate("xs", zero, step).alias("u"))
    return units.select("contract", "anchor", F.concat(F.col("file"), F.lit("#"), F.col("contract"), F.lit("."), short_name(F.col("anchor"))).alias("name"), "file", F.array_sort("u.fns").alias("fns"), F.col("u.sum").alias("chars"))


def fragments(units: DataFrame, functions: DataFrame) -> DataFrame:
    """(contract, anchor, file, start, end) of each unit's functions."""
    return units.select("contract", "anchor", F.explode("fns").alias("fn")).join(functions.select("contract", "fn", "file", "start", "end"), ["fn", "contract"]).select("contract", "anchor", "file", "start", "end")


def without_contained(units: DataFrame, order: list[str]) -> DataFrame:
    """Units whose set of function names is in no larger one's; of equal sets the first in order stays.

    Sets are compared by name over all contracts. Units that share a set meet by the set; candidates for containment
    meet by the set's rarest name, so a name that many units have costs nothing.
    """
    units = checkpointed(units)
    distinct = checkpointed(units.groupBy("fns").agg(F.min(F.struct(*order)).alias("_first")).withColumn("_set", F.monotonically_increasing_id()))
    # numbers of sets travel with names; the sets themselves only to the pairs that may contain one another
    names = distinct.select("_set", F.size("fns").alias("_size"), F.explode("fns").alias("fn"))
    rare = names.groupBy("fn").agg(F.count("*").alias("n"))
    keys = names.join(rare, "fn").groupBy("_set", "_size").agg(F.min(F.struct("n", "fn")).alias("k")).select(F.col("_set").alias("small"), F.col("_size").alias("small_size"), F.col("k.fn").alias("fn"))
    maybe = keys.join(names.select(F.col("_set").alias("large"), "_size", "fn"), "fn").where("_size > small_size").select("small", "large")
    sets = lambda name: distinct.select(F.col("_set").alias(name), F.col("fns").alias(f"_{name}"))
    inside = maybe.join(sets("small"), "small").join(sets("large"), "large").where(F.size(F.array_except("_small", "_large")) == 0).select(F.col("small").alias("_set")).distinct()
    kept = distinct.join(inside, "_set", "left_anti").select("fns", "_first")
    return units.select("*", F.struct(*order).alias("_order")).join(kept, "fns").where(F.col("_order") == F.col("_first")).drop("_order", "_first")


def call_graph_blocks(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """One text a contract: its functions with their visibility, flags and callees, in order."""
    callees = calls.groupBy(F.col("caller").alias("fn"), "contract").agg(F.array_join(F.array_sort(F.collect_set("callee")), ", ").alias("callees"))
    line = F.concat_ws(" ", F.concat(F.lit("- "), "fn"), "visibility", F.when(F.col("external_call"), "external-call"), F.when(F.col("sends_eth"), "sends-eth"), F.when(F.col("can_reenter"), "can-reenter"), F.when(F.col("callees").isNotNull(), F.concat(F.lit("calls "), "callees")))
    rows = functions.join(callees, ["fn", "contract"], "left").select("contract", "file", "fn", line.alias("line"))
    return rows.groupBy("contract").agg(F.min("file").alias("file"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fn", "line"))), lambda x: x["line"]), "\n").alias("block"))


def facts_for_units(units: DataFrame, facts: DataFrame) -> DataFrame:
    """(unit, path, block): each unit file's facts by path, else by name (the first path of it). units: (unit, path); facts: (file, block)."""
    from siftstone.functions.text import basename

    blocks = facts.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("block")), "\n\n").alias("block"))
    # files are found by their names alone, then a text is read once for what found it
    files = facts.select(F.col("file").alias("exact")).distinct()
    by_name = files.groupBy(basename(F.col("exact")).alias("name")).agg(F.min("exact").alias("other"))
    found = units.join(files, F.col("path") == F.col("exact"), "left").join(by_name, basename(F.col("path")) == F.col("name"), "left")
    return found.select("unit", "path", F.coalesce("exact", "other").alias("file")).join(blocks, "file").select("unit", "path", "block")
