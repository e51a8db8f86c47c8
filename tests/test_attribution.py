from spanloom.operators import attribution as A
from spanloom.operators import feedback

PAIRS = "m int, match_type string, auto array<struct<start:double,end:double>>, manual array<struct<start:double,end:double>>"


def steps(spark, pairs, **more):
    report = A.differences(spark.createDataFrame(pairs, PAIRS), ["m"])
    return report.first(), {r.param: r for r in A.attribute(report, ["m"], **more).collect()}


def test_late_ends_and_early_starts_ask_for_padding(spark):
    late = [(1, "1:1", [(i, i + 1.0)], [(i, i + 1.1)]) for i in map(float, range(5))]
    report, found = steps(spark, late)
    assert report.shifts == 5 and report.coverage == 1.0 and not report.structural
    assert set(found) == {"merging.padding"} and abs(found["merging.padding"].confidence - 0.5) < 1e-6 and found["merging.padding"].direction == "increase"
    both = [(1, "1:1", [(i, i + 1.0)], [(i - 0.06, i + 1.1)]) for i in map(float, range(1, 6))]
    _, found = steps(spark, both)
    assert abs(found["merging.padding"].observed - 0.06) < 1e-6  # the start's rule replaces the end's
    assert steps(spark, [(1, "1:1", [(0.0, 1.0)], [(0.005, 1.005)])])[1] == {}


def test_merges_splits_lengths_and_structure(spark):
    pairs = [(1, "1:N", [(0.0, 2.0)], [(0.0, 1.0), (1.0, 2.0)]), (1, "N:1", [(0.0, 1.0), (1.3, 2.0)], [(0.0, 2.0)]), (1, "N:1", [(3.0, 4.0), (4.1, 5.0)], [(3.0, 5.0)]), (1, "1:1", [(6.0, 9.0)], [(6.0, 7.0)]), (1, "INSERT", [(9.0, 9.5)], []), (1, "DELETE", [], [(9.0, 9.5)]), (1, "DELETE", [], [(9.0, 9.5)])]
    report, found = steps(spark, pairs)
    assert (report.merges, report.splits, report.unmatched, report.structural) == (2, 1, 3, True) and abs(report.gap - 0.3) < 1e-9
    assert set(found) == {"merge_decision.fast_merge_max_gap", "subtitle.max_duration"}  # the surer of the two gap rules
    assert found["subtitle.max_duration"].direction == "decrease" and found["subtitle.max_duration"].confidence == 1.0
    assert "merge_decision.llm_decision_max_gap" in steps(spark, pairs, isolate=False)[1]


def test_coupled_parameters_and_learning(spark):
    a, b, c = A.COUPLED[0][0], A.COUPLED[0][1], A.COUPLED[1][1]
    kind = "m int, param string, tier string, observed double, confidence double, weight double, direction string"
    rows = [(1, a, "x", 1.0, 0.5, 1.0, "increase"), (1, b, "x", 1.0, 0.5, 1.0, "increase"), (1, c, "x", 1.0, 0.4, 1.0, "decrease"), (2, b, "x", 1.0, 0.3, 1.0, "increase"), (2, c, "x", 1.0, 0.4, 1.0, "increase"), (3, "other", "x", 1.0, 0.0, 1.0, "increase")]
    chosen = A.select_steps(spark.createDataFrame(rows, kind), ["m"])
    # of the first pair the second goes at a tie, so the second pair has one left
    assert {(r.m, r.param) for r in chosen.collect()} == {(1, a), (1, c), (2, c), (3, "other")}
    values = spark.createDataFrame([(1, a, 0.5, 20), (1, c, 0.5, 4), (2, c, 0.5, 1)], "m int, param string, value double, samples int")
    got = {(r.m, r.param): round(r.new, 6) for r in A.learn(chosen, values, ["m"], {a: (0.1, 0.6)}).collect()}
    assert got == {(1, a): 0.6, (1, c): 0.35}  # held at the bound; too few samples leave a value alone


def test_gain_of_decimals_is_exact_in_any_order_of_rows(spark):
    # every amount with every tax from 0 to 8 %: the gain is 4 % to the last digit, which is a tie with the least gain
    rows = [(k, float(q), q * (1 + tax / 100)) for k in range(12) for q in range(1 + k, 40 + 3 * k) for tax in range(9)]
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[2])):
        got = feedback.shadow_verdict(spark.createDataFrame(order, "k int, base double, trial double"), ["k"], "base", "trial", 30, 0.04).collect()
        assert {(r.gain, r.verdict) for r in got} == {(0.04, "upgrade")} and len(got) == 12
    plain = feedback.shadow_verdict(spark.createDataFrame([(1, 1 / 3, 2 / 3), (1, float("inf"), 1.0), (2, 1 / 3, 2 / 3), (2, None, None)], "k int, base double, trial double"), ["k"], "base", "trial", 1, 0.04)
    assert {r.k: (r.runs, round(r.gain, 9) if r.k == 2 else None) for r in plain.collect()} == {1: (2, None), 2: (1, 1.0)}


def test_nearest_centroids_are_broadcast_or_dealt(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v, c = rng.normal(size=(30, 5)), rng.normal(size=(40, 5))
    v[4] = 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id int, v array<double>")
    centroids = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "label int, c array<double>")
    size = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(c, axis=1)
    near = np.where(size == 0, 0, v @ c.T / np.where(size == 0, 1, size)).round(12)
    want = {(i, int(label), rank) for i in range(30) for rank, label in enumerate(np.lexsort((np.arange(40), -near[i]))[:3], 1)}
    for block in (256, 2):  # of one label a block, 20 blocks are beyond those that are broadcast
        hits = feedback.nearest_centroids(vectors, centroids, 3, block)
        assert {(r.vec_id, r.label, r["rank"]) for r in hits.collect()} == want
    # a block's vectors never meet under one key
    plan = feedback.nearest_centroids(vectors, centroids, 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(_b" not in plan.split("BroadcastExchange")[0]
