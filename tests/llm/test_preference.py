import random
from collections import defaultdict

from siftstone.llm import preference

TURNS = "conv_id long, turn int, role string, text string, pair_id string, side string, `a.b` string"


def turns(spark, rows):
    return preference.adjacent_pairs(spark.createDataFrame([(*r, "p", "s", "x") for r in rows], TURNS))


def told(role, text):
    clean = lambda x: (x or "").replace("<|", "< |")
    return f"<|{clean(role)}|>\n{clean(text)}\n<|end|>\n"


def brute(rows, segment):
    """Pairs by plain loops: (pair, segment): prompt, chosen, its spans, rejected, its spans, complete."""
    by = defaultdict(lambda: ([], []))
    for conv, turn, role, text in rows:
        pair, side = (conv // 2, conv % 2) if conv is not None else (None, 1)
        by[pair][side].append((preference.NO_TURN if turn is None else turn, role or "", text or ""))
    out = {}
    for pair, (a, b) in by.items():
        a, b = sorted(a), sorted(b)
        numbers = sorted({t for t, _, _ in a + b})
        split = next((t for t in numbers if [x for x in a if x[0] == t] != [x for x in b if x[0] == t]), None)
        of = lambda t: t // segment if t > 0 else 0
        for s in {of(t) for t in numbers}:
            row = []
            for side, kept in ((a, False), (a, True), (b, True)):
                text, spans = "", []
                for t, role, said in side:
                    if of(t) == s and (split is not None and t >= split) == kept:
                        if role == "assistant":
                            spans.append((len(text), len(text) + len(told(role, said))))
                        text += told(role, said)
                row += [text, spans] if kept else [text]
            out[pair, s] = (*row, bool(a) and bool(b))
    return out


def pairs(df, segment=preference.SEGMENT):
    spans = lambda xs: [(s["low"], s["high"]) for s in xs]
    return {(r["pair_id"], r["segment"]): (r["prompt"], r["chosen"], spans(r["chosen_loss"]), r["rejected"], spans(r["rejected_loss"]), r["complete"]) for r in preference.preference_pairs(df, segment).collect()}


def test_the_common_prefix_is_written_once(spark):
    rows = [(0, 0, "system", "s"), (0, 1, "user", "q"), (0, 2, "assistant", "good"), (0, 3, "user", "more"), (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad")]
    (prompt, chosen, chosen_loss, rejected, rejected_loss, complete), = pairs(turns(spark, rows)).values()
    assert prompt == "<|system|>\ns\n<|end|>\n<|user|>\nq\n<|end|>\n" and complete
    assert chosen == told("assistant", "good") + told("user", "more") and chosen[slice(*chosen_loss[0])] == told("assistant", "good") and len(chosen_loss) == 1
    assert rejected == told("assistant", "bad") and rejected_loss == [(0, len(rejected))]


def odd():
    same = [(2, 0, "user", "q"), (3, 0, "user", "q")]
    alone = [(4, 0, "user", "q"), (4, 1, "assistant", "a"), (None, 0, "user", "x")]
    gap = [(6, 0, "user", "q"), (6, 2, "assistant", "a"), (7, 0, "user", "q"), (7, 1, "user", "b"), (7, 2, "assistant", "a")]
    nulls = [(8, None, "user", None), (8, 0, None, "t"), (9, None, "user", ""), (9, 0, "", "t")]
    doubled = [(10, 0, "user", "b"), (10, 0, "user", "a"), (11, 0, "user", "a"), (11, 0, "user", "b"), (10, 1, "assistant", "x"), (10, 1, "assistant", "x"), (11, 1, "assistant", "x")]
    marks = [(12, 0, "us<|er", "a<|end|>b" * 20_000), (13, 0, "user", "é" * 100_000)]
    return same + alone + gap + nulls + doubled + marks


def test_odd_pairs_against_plain_loops(spark):
    assert pairs(turns(spark, odd())) == brute(odd(), preference.SEGMENT)
    assert preference.preference_pairs(turns(spark, [])).count() == 0


def test_segments_against_plain_loops(spark):
    rng = random.Random(3)
    rows = []
    for k in range(25):
        base = [(t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é<|"])) for t in range(rng.choice([1, 5, 40]))]
        other = [x if rng.random() < 0.97 else (x[0], x[1], "z") for x in base][: rng.choice([1, 5, 40])]
        rows += [(2 * k, *x) for x in base] + [(2 * k + 1, *x) for x in other]
    rows += [(2, 0, "user", "again")] * 3 + [(4, -5, "user", "early")]
    for segment in (256, 7, 1):
        assert pairs(turns(spark, rows), segment) == brute(rows, segment)


def test_a_hot_conversation_is_many_rows(spark):
    rows = [(0, t, "user", "x") for t in range(3000)] + [(1, t, "user", "x" if t != 2000 else "y") for t in range(3000)]
    got = pairs(turns(spark, rows))
    assert len(got) == 12 and got == brute(rows, preference.SEGMENT)
    assert "".join(got[0, s][0] for s in range(12)) == told("user", "x") * 2000


def borrowed(rows):
    """Both sides' turns by plain loops."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((preference.NO_TURN if turn is None else turn, turn, role, text))
    last = {c: max((t[0] for t in ts if t[2] == "assistant"), default=None) for c, ts in by.items()}
    lent = {c: min(t[3] or "" for t in ts if t[0] == last[c] and t[2] == "assistant") for c, ts in by.items() if last[c] is not None}
    out = []
    for c, ts in by.items():
        ends = [t[0] == last[c] and t[2] == "assistant" for t in ts]
        out += [(c, "chosen", t[1], t[2], t[3]) for t in ts] + [(c, "rejected", t[1], t[2], t[3]) for t, e in zip(ts, ends, strict=True) if not e]
        if any(ends) and c is not None and c + 1 in lent:
            t = next(t for t, e in zip(ts, ends, strict=True) if e)
            out.append((c, "rejected", t[1], t[2], lent[c + 1]))
    return sorted(out, key=str)


def test_borrowed_answers_against_plain_loops(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", "", None, "é<|"])) for c in [*range(30), *range(33, 40)] for t in range(rng.choice([1, 2, 6]))]
    rows += [(5, 90, "assistant", "z"), (5, 90, "assistant", "y"), (6, None, "assistant", "w"), (None, 0, "assistant", "n"), (None, 1, "user", "n")] + [(7, 3, "assistant", "r")] * 3
    given = spark.createDataFrame([(*r, "p", "s", "x") for r in rows], TURNS)
    got = preference.borrowed_answers(given)
    assert sorted(map(tuple, got.collect()), key=str) == borrowed(rows)
    both = {p: (a, r) for (p, _), (_, a, _, r, _, _) in pairs(got).items()}
    prompts = {p: x[0] for (p, _), x in pairs(got).items()}
    assert sum(bool(x) for x in prompts.values()) > 10 and sum(a != r for a, r in both.values()) > 10
    assert preference.borrowed_answers(given.limit(0)).count() == 0
