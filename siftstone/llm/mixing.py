"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Targets: source weights share all of the corpus's words; a target stops at ``max_copies`` times its source's words, and
what that leaves over is shared by weight among the others until none is above. With sources in the order of
cap / weight, the level at which the rest is shared follows from running sums, so no loop is needed; numbers and sums go
by key ranges (``siftstone.llm.order``), so sources may be as many as hosts.

Rounding: each document of a source should be taken ``target / source words`` times. The whole copies are certain; the
fraction is a probability. Two sides with fractional probabilities are paired: words of expectation move from one to
the other, the way drawn at random, until one side is 0 or 1. With a words at p and b words at q, ``up`` = min(a(1-p),
bq) words can move to the first and ``down`` = min(ap, b(1-q)) to the second; it rises with the chance
down / (up + down), so both keep their expectations, and ap + bq never changes.

Documents are dealt into groups of about ``group`` by a hash, each of one probability. On the first level the second side
of a pair is all smaller documents of the group together, of b words in all at one probability q: what moves is shared by
them in proportion to their words, so all go to the same new q, and each one's expectation is kept as that of the side
is. This is a pivotal step between a document and a unit of several; pairing single documents instead leaves a long one
fractional to the end (on the tables here a source then misses its target by up to 12 %). What stays fractional, one
small document a group at most, meets in groups of the next level, where documents are paired one by one, and so on: a
reduction tree of logarithmic depth, each level an aggregation over groups of bounded size, so a source with a third of
all rows is just more groups. The last residual of a source is drawn by its probability; the source is off its target by
less than that document's words.

Draws are hashes of document ids, texts, the level and, for rows alike in both, their number: reruns agree.

Defined cases: a null source is a source of its own, the last; a null or empty text has no words and 0 taken; a source
without words has target 0; very long texts are counted whole; repeated rows are drawn each for itself (rows alike are
numbered in any order, so only their sum is defined); an empty table gives an empty result; ``mix`` carries all other
columns along, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed, col, n_words, snapshot, unit_hash
from siftstone.llm.order import in_order

WEIGHTS = (1.0, 2.0, 3.0)
MAX_COPIES = 3.0
GROUP = 128


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size). One row a source; sums are partial before the shuffle."""
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # by code point, null last; strings compare by their UTF-8 bytes
    numbered = in_order(sources.withColumn("last", F.col("source").isNull()), ["last", "source"])
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(max_copies)).withColumn("ratio", F.col("cap") / F.col("weight"))
    totals = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight = totals["words"] or 0, totals["weight"] or 0.0
    by_ratio = in_order(weighed.drop("place"), ["ratio", "last", "source"], sums=["cap", "weight"])
    # level: words for each unit of weight if this source and the later ones share what the earlier ones, at their caps, leave
    shared = by_ratio.withColumn("level", (F.lit(words) - F.col("cap_before")) / (F.lit(weight) - F.col("weight_before")))
    # the first source whose cap is not below its share sets the level of all later ones; none can be without one but for rounding
    level = shared.agg(F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).alias("level")).first()["level"]
    return shared.select("source", "source_size", F.least("cap", F.coalesce(F.lit(level).cast("double"), F.col("level")) * F.col("weight")).alias("target"))


ITEM = "struct<size:bigint,u:double,id:bigint,n:bigint,p:double>"


def _pair(level: int) -> Column:
    """Fold a group's items: the residual and the next item exchange expectation until one is 0 or 1; that one is put out."""
    none = F.lit(None).cast(ITEM)
    start = F.struct(none.alias("left"), F.array().cast(f"array<{ITEM}>").alias("done"))

    def item(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["u"].alias("u"), x["id"].alias("id"), x["n"].alias("n"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        left = acc["left"]
        a, b, p, q = left["size"].cast("double"), x["size"].cast("double"), left["p"], x["p"]
        up = F.least(a * (1 - p), b * q)  # words that can move from x to the residual
        down = F.least(a * p, b * (1 - q))
        rises = unit_hash(F.lit(level), left["id"], left["n"], x["id"], x["n"]) * (up + down) < down
        new_p = F.when(rises, F.when(up >= a * (1 - p), 1.0).otherwise(F.least(p + up / a, F.lit(1.0)))).otherwise(F.when(down >= a * p, 0.0).otherwise(F.greatest(p - down / a, F.lit(0.0))))
        new_q = F.when(rises, F.when(up >= b * q, 0.0).otherwise(F.greatest(q - up / b, F.lit(0.0)))).otherwise(F.when(down >= b * (1 - q), 1.0).otherwise(F.least(q + down / b, F.lit(1.0))))
        one, two = item(left, new_p), item(x, new_q)
        settled = new_p.isin(0.0, 1.0)
        other_settled = new_q.isin(0.0, 1.0)
        both = F.struct(none.alias("left"), F.concat(acc["done"], F.array(one, two)).alias("done"))
        first = F.struct(two.alias("left"), F.concat(acc["done"], F.array(one)).alias("done"))
        second = F.struct(one.alias("left"), F.concat(acc["done"], F.array(two)).alias("done"))
        return F.when(left.isNull(), F.struct(x.alias("left"), acc["done"].alias("done"))).when(settled & other_settled, both).when(settled, first).otherwise(second)

    return F.aggregate(F.col("items"), start, step)


def _pooled() -> Column:
    """Fold a group of one probability, largest first: each item is paired with the rest, whose common probability is ``q``."""
    start = F.struct(F.get("items", F.lit(0))["p"].alias("q"), F.col("words").alias("rest"), F.lit(None).cast(ITEM).alias("left"), F.array().cast(f"array<{ITEM}>").alias("done"))

    def item(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), x["u"].alias("u"), x["id"].alias("id"), x["n"].alias("n"), p.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        q, a, left_words = acc["q"], x["size"].cast("double"), acc["rest"] - x["size"]
        r = left_words.cast("double")
        up, down = F.least(a * (1 - q), r * q), F.least(a * q, r * (1 - q))
        rises = unit_hash(F.lit("pool"), x["id"], x["n"]) * (up + down) < down
        new_p = F.when(rises, F.when(up >= a * (1 - q), 1.0).otherwise(F.least(q + up / a, F.lit(1.0)))).otherwise(F.when(down >= a * q, 0.0).otherwise(F.greatest(q - down / a, F.lit(0.0))))
        new_q = F.when(rises, F.when(up >= r * q, 0.0).otherwise(F.greatest(q - up / r, F.lit(0.0)))).otherwise(F.when(down >= r * (1 - q), 1.0).otherwise(F.least(q + down / r, F.lit(1.0))))
        put = lambda p: F.concat(acc["done"], F.array(item(x, p)))
        over = F.struct(q.alias("q"), left_words.alias("rest"), acc["left"].alias("left"), put(q).alias("done"))  # the rest is settled
        last = F.struct(q.alias("q"), left_words.alias("rest"), item(x, q).alias("left"), acc["done"].alias("done"))
        settled = F.struct(new_q.alias("q"), left_words.alias("rest"), acc["left"].alias("left"), put(new_p).alias("done"))
        open_ = F.struct(new_q.alias("q"), left_words.alias("rest"), item(x, new_p).alias("left"), acc["done"].alias("done"))
        return F.when(q.isin(0.0, 1.0), over).when(left_words <= 0, last).when(new_p.isin(0.0, 1.0), settled).otherwise(open_)

    return F.aggregate("items", start, step, lambda acc: F.struct(acc["left"].alias("left"), acc["done"].alias("done")))


def rounded(items: DataFrame, group: int = GROUP) -> DataFrame:
    """(id, n, p): p is 0 or 1, drawn from rows (source, size > 0, id, n, p) so that each source's sum of size * p is kept."""
    drawn = F.struct(F.col("size"), unit_hash(F.col("id"), F.col("n"), F.lit("order")).alias("u"), "id", "n", "p").cast(ITEM)
    out = [items.where("p <= 0 or p >= 1").select("id", "n", F.when(F.col("p") > 0, 1.0).otherwise(0.0).alias("p"))]
    left = items.where("p > 0 and p < 1").select("source", drawn.alias("item"))
    level = 0
    while True:
        level += 1
        # on the first level a group is of one probability
        kind = F.col("item.p") if level == 1 else F.lit(0.0)
        rows = left.withColumn("kind", kind)
        counts = rows.groupBy(F.col("source").alias("of"), F.col("kind").alias("k")).agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
        sized = rows.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("kind") == F.col("k")))  # a null source is one too
        dealt = sized.withColumn("place", F.pmod(F.xxhash64("item.id", "item.n", F.lit(level)), F.col("groups")))
        groups = dealt.groupBy("source", "kind", "place").agg(F.reverse(F.array_sort(F.collect_list("item"))).alias("items"), F.sum("item.size").alias("words"))
        folded = checkpointed(groups.select("source", (_pooled() if level == 1 else _pair(level)).alias("fold")))
        out.append(folded.select(F.explode("fold.done").alias("item")).select("item.id", "item.n", "item.p"))
        left = folded.where("fold.left is not null").select("source", F.col("fold.left").alias("item"))
        if left.groupBy("source").count().where("count > 1").isEmpty():
            break
    p = F.when(unit_hash(F.col("item.id"), F.col("item.n"), F.lit("root")) < F.col("item.p"), 1.0).otherwise(0.0)
    out.append(left.select("item.id", "item.n", p.alias("p")))
    return reduce(DataFrame.unionByName, out)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES, group: int = GROUP, row: str | None = None) -> DataFrame:
    """(doc_id, id, n, size, source_size, target, copies[, row]) for each row; n is its number in the order of id, a hash of text and doc_id; row a column to carry."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text", "doc_id").alias("id"), *([F.col(row).alias("_row")] if row else []))
    # written before the ranges are drawn from it, so the texts are read once
    numbered = in_order(checkpointed(keyed), ["id", "doc_id", "size", "source"]).withColumnRenamed("place", "n")
    targets = source_targets(numbered, weights, max_copies).withColumnRenamed("source", "of")
    share = F.when(F.col("source_size") > 0, F.least(F.lit(max_copies), F.col("target") / F.col("source_size"))).otherwise(0.0)
    aimed = numbered.join(targets, F.col("source").eqNullSafe(F.col("of"))).withColumn("share", share).withColumn("whole", F.floor("share"))
    items = aimed.where("size > 0").select("source", "size", "id", "n", (F.col("share") - F.col("whole")).alias("p"))
    draws = rounded(items, group).select(F.col("n").alias("drawn"), "p")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("p"), F.lit(0.0))).otherwise(0).cast("long")
    return aimed.join(draws, F.col("n") == F.col("drawn"), "left").select("doc_id", "id", "n", "size", "source_size", "target", copies.alias("copies"), *(["_row"] if row else []))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """docs with each row as often as it is drawn, columns as given."""
    names = docs.columns
    # rows get ids of their own, written with them, so that rows alike in all columns are told apart without a task that holds them
    kept = snapshot(docs.select(F.struct(*(col(c).alias(c) for c in names)).alias("row"), F.monotonically_increasing_id().alias("of")))
    lean = kept.select("row.doc_id", "row.source", "row.text", "of")
    drawn = mixed(lean, weights, max_copies, row="of").where("copies > 0").select("_row", "copies")
    repeated = kept.join(drawn, F.col("of") == F.col("_row")).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*(F.col("row")[c].alias(c) for c in names))
