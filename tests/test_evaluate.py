"""Scores against loops, and the arithmetic of published results."""

import random

from spanloom.operators import evaluate as E
from spanloom.operators import spans

SPAN = "doc_id long, start int, end int, line int"


def make(spark, seed, n=120):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = rng.randrange(40)
        rows.append((rng.randrange(6), s, s + rng.randrange(1, 6), rng.choice([None, 1, 2]), rng.random()))
    return rows, spark.createDataFrame(rows, SPAN + ", score double")


def test_counts_match_one_to_one_with_null_lines(spark):
    g, gold = make(spark, 1)
    p, pred = make(spark, 2)
    for keys, cut in ((("doc_id", "start", "end"), 3), (E.STRICT, 4)):
        left, tp = [r[:cut] for r in g], 0
        for r in p:
            if r[:cut] in left:
                left.remove(r[:cut])
                tp += 1
        assert tuple(E.counts(gold, pred, keys).first()) == (tp, len(p) - tp, len(g) - tp)


def test_greedy_overlap_is_the_loop(spark):
    g, gold = make(spark, 3, 60)
    p, pred = make(spark, 4, 60)
    tp = 0
    for d in range(6):
        key = lambda r: (r[1], r[2], -1 if r[3] is None else r[3])
        gs, ps = sorted((r for r in g if r[0] == d), key=key), sorted((r for r in p if r[0] == d), key=key)
        pairs = sorted((-(min(a[2], b[2]) - max(a[1], b[1])), i, j) for i, a in enumerate(ps) for j, b in enumerate(gs) if min(a[2], b[2]) > max(a[1], b[1]))
        seen_p, seen_g = set(), set()
        for _, i, j in pairs:
            if i not in seen_p and j not in seen_g:
                seen_p.add(i)
                seen_g.add(j)
                tp += 1
    assert E.greedy_overlap(gold, pred).first()["tp"] == tp


def test_itself_is_perfect_and_swapping_swaps(spark):
    _, gold = make(spark, 5)
    _, pred = make(spark, 6)
    assert tuple(E.scored(gold, gold).first())[3:] == (1.0, 1.0, 1.0)
    a, b = E.scored(gold, pred).first(), E.scored(pred, gold).first()
    assert (a.precision, a.recall, a.f1) == (b.recall, b.precision, b.f1)


def test_adjudicated_cases(spark):
    lab = spark.createDataFrame([(1, 0, 5, 1, "POLICY_POSITIVE"), (1, 10, 15, 2, "POLICY_NEGATIVE"), (1, 20, 25, 3, "AMBIGUOUS_EXCLUDED")], SPAN + ", label string")
    cases = (([(1, 0, 5, 1)], (1, 0, 0)), ([(1, 0, 5, 1), (1, 10, 15, 2), (1, 20, 25, 3)], (1, 1, 0)), ([], (0, 0, 1)), ([(1, 0, 5, 9)], (0, 1, 1)), ([(2, 0, 1, 1)], (0, 1, 1)))
    for rows, want in cases:
        pred = spark.createDataFrame([(*r, 1.0) for r in rows], SPAN + ", score double")
        assert tuple(E.adjudicated(lab, pred).first())[:3] == want
    assert E.above(spark.createDataFrame([(1, 0, 5, 1, 0.99), (1, 0, 5, 1, None)], SPAN + ", score double"), 0.999).count() == 1


def test_published_arithmetic(spark):
    rows = spark.createDataFrame([(21, 138, 24), (17, 177, 28), (3, 108, 42)], "tp long, fp long, fn long")
    got = [tuple(r) for r in rows.select(*E.prf(rows.tp, rows.fp, rows.fn)).collect()]
    assert got == [(0.1321, 0.4667, 0.2059), (0.0876, 0.3778, 0.1423), (0.027, 0.0667, 0.0385)]
    assert round(E.mcnemar_p(18, 5), 4) == 0.0106 and round(E.mcnemar_p(1, 5), 4) == 0.2188


def test_tools_that_did_not_run_have_no_score(spark):
    gold = spark.createDataFrame([("a", True, 1), ("b", False, None)], "file string, has boolean, line int")
    det = spark.createDataFrame([("t", "a", 1), ("t", "b", -1)], "tool string, file string, line int")
    tools = spark.createDataFrame([("t", "ok"), ("u", "not_installed")], "tool string, status string")
    got = {r.tool: r for r in E.tool_scores(E.tool_rows(gold, det), tools).collect()}
    assert tuple(got["t"])[1:] == ("ok", 1, 1, 0, 0.5, 1.0, 0.667, 1, 0, 0, 1.0, 1.0, 1.0)
    assert got["u"].status == "NOT RUN" and got["u"].file_tp is None


def test_interval_joins_are_no_nested_loops(spark):
    _, gold = make(spark, 7)
    plan = spans.overlapping(gold, gold)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
