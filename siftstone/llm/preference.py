"""Preference formatting: a shared prompt and two masked completions, in DataFrame operations only.

A pair is two conversations, one chosen and one rejected. The first turn in which the sides differ, by what they say and
not by hashes of it, ends the common prefix. All turns before it are the prompt, written once; the rest of each side is
its completion. The mask of a completion is the spans of characters that count for the loss: what the assistant says.

A row of the result is one pair: prompt, both completions, both masks. Pairs of very many turns have a row for each
``SEGMENT`` turn numbers (segment 0, 1, ...), whose texts put end to end in order give the pair's and whose spans count
from the segment's own beginning; so no conversation needs to be one value, and a conversation that holds a third of all
turns is many groups. Each segment's sides are gathered and compared in their segment, the narrow result (a row a
segment) gives the pair's first difference, and that goes back to the segments by a join that skew handling can split.
Rows alike are counted before anything is gathered.

``conversations`` holds no preferences, and no two of its conversations begin alike, so the query makes pairs that do
(``borrowed_answers``): a conversation is the chosen side, and the rejected one is the same conversation with its last
assistant turns replaced by those of another, the next number's. All conversations and all their turns are in the pairs.

Defined cases: several rows of one turn are ordered by role and text, and compared together, repeated ones as often as
they are there; a missing turn differs from any other; a null turn number comes first, with segment 0, null roles and
texts are empty; a null conversation is the rejected side of a pair without number; a conversation without its partner
is a completion whole, and its pair isn't complete; equal sides have a prompt only; very long texts are written whole;
an empty table gives an empty result; other columns of the table aren't read, whatever their names. Marks of the
template in a text are broken up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import part

OPEN, ROLE_END, CLOSE = "<|", "|>\n", "<|end|>\n"
ASSISTANT = "assistant"
#: Turn numbers of a row; the turn number that stands for none.
SEGMENT, NO_TURN = 256, -(1 << 31)


def rendered(role: Column, text: Column) -> Column:
    """A turn in the template; "<|" in role or text becomes "< |"."""
    clean = lambda c: F.replace(c, F.lit(OPEN), F.lit("< |"))
    return F.concat(F.lit(OPEN), clean(role), F.lit(ROLE_END), clean(text), F.lit("\n" + CLOSE))


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """Turns of pairs made of conversations 2k (chosen) and 2k + 1 (rejected)."""
    k = F.col("conv_id").cast("long")
    side = F.when(F.pmod(k, F.lit(2)) == 0, "chosen").otherwise("rejected")
    return conversations.select(F.floor(k / 2).cast("long").alias("pair_id"), side.alias("side"), F.col("turn").cast("int").alias("turn"), "role", "text")


def borrowed_answers(conversations: DataFrame) -> DataFrame:
    """Turns of pairs: each conversation as chosen, and as rejected with its last assistant turn's text from the next.

    The next conversation of n is the one whose number is n + 1; of several rows of its last assistant turn the least text
    counts. Where it is missing or has no such turn, the rejected side's turn is left out; a conversation without an
    assistant turn is alike on both sides. A null number is a conversation that lends nothing. What travels is one text a
    conversation, by its number; the turns are read where they lie and once more for the last turns' numbers.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    answers = rows.where(F.col("role") == ASSISTANT)
    last = answers.groupBy("pair_id", part(F.col("pair_id"))).agg(F.max(F.coalesce("turn", F.lit(NO_TURN))).alias("at")).select(F.col("pair_id").alias("of"), "at")
    marked = rows.join(last, F.col("pair_id").eqNullSafe(F.col("of")), "left").withColumn("ends", (F.col("role") == ASSISTANT) & (F.coalesce("turn", F.lit(NO_TURN)) == F.col("at")))
    marked = marked.withColumn("ends", F.coalesce("ends", F.lit(False))).select("pair_id", "turn", "role", "text", "ends")
    lent = marked.where("ends").groupBy("pair_id", part(F.col("pair_id"))).agg(F.min(F.coalesce("text", F.lit(""))).alias("lent")).select((F.col("pair_id") - 1).alias("to"), "lent")
    chosen = marked.select("pair_id", F.lit("chosen").alias("side"), "turn", "role", "text")
    same = marked.where("not ends").select("pair_id", F.lit("rejected").alias("side"), "turn", "role", "text")
    # one row of the last turn however many it has
    places = marked.where("ends").select("pair_id", "turn", "role").distinct()
    changed = places.join(lent, F.col("pair_id") == F.col("to")).select("pair_id", F.lit("rejected").alias("side"), "turn", "role", F.col("lent").alias("text"))
    return chosen.unionByName(same).unionByName(changed)


def _spans(turns: Column) -> Column:
    """[low, high) of the assistant's turns in the text that the turns make, each as often as it is there."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<low:int,high:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["said"])
        return F.struct(end.alias("at"), F.when(x["role"] == ASSISTANT, F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("low"), end.alias("high"))))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def preference_pairs(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """pair_id, segment, prompt, chosen, chosen_loss, rejected, rejected_loss (arrays of spans) and complete (both sides are there)."""
    known = F.coalesce("turn", F.lit(NO_TURN))
    rows = turns.select("pair_id", F.when(F.col("turn") > 0, F.floor(F.col("turn") / segment)).otherwise(0).cast("int").alias("segment"), (F.col("side") == "chosen").alias("first"), known.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.groupBy("pair_id", "segment", "first", "turn", "role", "text").agg(F.count("*").alias("n"))
    item = F.struct("turn", "role", "text", "n")
    of = lambda mine: F.array_sort(F.collect_list(F.when(mine, item)))
    sides = counted.groupBy("pair_id", "segment").agg(of(F.col("first")).alias("a"), of(~F.col("first")).alias("b"))
    # in order of turn, role and text: the lesser turn where the sides first differ is the first that differs
    differ = F.filter(F.zip_with("a", "b", lambda x, y: F.when(~x.eqNullSafe(y), F.least(x["turn"], y["turn"]))), lambda t: t.isNotNull())
    sides = sides.withColumn("differs", F.get(differ, F.lit(0)))
    splits = sides.groupBy("pair_id", part(F.col("pair_id"))).agg(F.min("differs").alias("split"), F.max((F.size("a") > 0).cast("int")).alias("has_a"), F.max((F.size("b") > 0).cast("int")).alias("has_b"))
    splits = splits.select(F.col("pair_id").alias("of"), "split", (F.col("has_a") + F.col("has_b") == 2).alias("complete"))
    joined = sides.join(splits, F.col("pair_id").eqNullSafe(F.col("of")))
    # a repeated row is as many turns
    told = lambda xs: F.flatten(F.transform(xs, lambda x: F.array_repeat(F.struct(x["role"].alias("role"), rendered(x["role"], x["text"]).alias("said")), x["n"].cast("int"))))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x["said"]), "")
    before = lambda x: F.col("split").isNull() | (x["turn"] < F.col("split"))
    parts = joined.select("pair_id", "segment", "complete", told(F.filter("a", before)).alias("p"), told(F.filter("a", lambda x: ~before(x))).alias("c"), told(F.filter("b", lambda x: ~before(x))).alias("r"))
    return parts.select("pair_id", "segment", text(F.col("p")).alias("prompt"), text(F.col("c")).alias("chosen"), _spans(F.col("c")).alias("chosen_loss"), text(F.col("r")).alias("rejected"), _spans(F.col("r")).alias("rejected_loss"), "complete")


def as_text(spans: Column) -> Column:
    """Spans as "low-high,low-high"."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["low"].cast("string"), s["high"].cast("string"))), ",")


#: preference_pairs(borrowed_answers(conversations)) in SQL, with spans as text.
ORACLE_SQL = """
WITH given AS (SELECT conv_id AS pair_id, turn, coalesce(turn, -2147483648) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
ends AS (SELECT pair_id, max(place) AS last FROM given WHERE role = 'assistant' GROUP BY pair_id),
marked AS (SELECT g.*, role = 'assistant' AND place IS NOT DISTINCT FROM last AS ends FROM given g LEFT JOIN ends e ON g.pair_id IS NOT DISTINCT FROM e.pair_id),
lent AS (SELECT pair_id - 1 AS pair_id, min(text) AS lent FROM marked WHERE ends GROUP BY ALL),
sides AS (SELECT pair_id, true AS a, place AS turn, role, text FROM marked UNION ALL SELECT pair_id, false, place, role, text FROM marked WHERE NOT ends
UNION ALL SELECT m.pair_id, false, place, role, lent FROM (SELECT DISTINCT pair_id, place, role FROM marked WHERE ends) m JOIN lent l ON m.pair_id = l.pair_id),
turns AS (SELECT pair_id, a, turn, CASE WHEN turn > 0 THEN turn // 256 ELSE 0 END AS segment, role, text FROM sides),
by_turn AS (SELECT pair_id, turn, list_sort(list(role || chr(0) || text) FILTER (a)) x, list_sort(list(role || chr(0) || text) FILTER (NOT a)) y FROM turns GROUP BY ALL),
splits AS (SELECT pair_id, min(turn) FILTER (x IS DISTINCT FROM y) split, bool_or(x IS NOT NULL) AND bool_or(y IS NOT NULL) complete FROM by_turn GROUP BY ALL),
said AS (SELECT pair_id, segment, complete, turn, role, text, CASE WHEN split IS NULL OR turn < split THEN 'prompt' WHEN a THEN 'chosen' ELSE 'rejected' END AS part, a,
'<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS told FROM turns JOIN splits USING (pair_id)),
placed AS (SELECT *, row_number() OVER w AS i, coalesce(sum(length(told)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM said WHERE part <> 'prompt' OR a WINDOW w AS (PARTITION BY pair_id, segment, part ORDER BY turn, role, text)),
parts AS (SELECT pair_id, segment, part, string_agg(told, '' ORDER BY i) AS body, string_agg(CAST(CAST(low AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(low + length(told) AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (role = 'assistant') AS spans FROM placed GROUP BY ALL),
pairs AS (SELECT DISTINCT pair_id, segment, complete FROM said)
SELECT p.pair_id, CAST(p.segment AS INT) AS segment, coalesce(q.body, '') AS prompt, coalesce(c.body, '') AS chosen, coalesce(c.spans, '') AS chosen_loss, coalesce(r.body, '') AS rejected, coalesce(r.spans, '') AS rejected_loss, complete
FROM pairs p LEFT JOIN parts q ON p.pair_id = q.pair_id AND p.segment = q.segment AND q.part = 'prompt' LEFT JOIN parts c ON p.pair_id = c.pair_id AND p.segment = c.segment AND c.part = 'chosen' LEFT JOIN parts r ON p.pair_id = r.pair_id AND p.segment = r.segment AND r.part = 'rejected'
"""
