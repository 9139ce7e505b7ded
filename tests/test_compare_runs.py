from prosewright.operators.evaluation import compare_runs

# experiment: base costs, new costs, base recalls, new recalls, and (conclusion, reason, accuracy, exploratory, verdict of the cost)
CASES = {
    "better": ([5, 6, 7], [2, 3, 4], [0.9, 0.8, 0.9], [0.8, 0.9, 0.8], ("better", None, "kept", False, "less")),
    "worse": ([2, 3, 4], [5, 6, 7], [0.9] * 3, [0.9] * 3, ("worse", None, "kept", False, "more")),
    "overlap": ([2, 3, 5], [4, 6, 7], [0.9] * 3, [0.9] * 3, ("undecided", None, "kept", False, "undecided")),
    "tie": ([3, 3, 3], [3, 2, 1], [0.9] * 3, [0.9] * 3, ("undecided", None, "kept", False, "undecided")),
    "accuracy": ([5, 6, 7], [2, 3, 4], [0.9] * 3, [0.9, 0.9, 0.7], ("accuracy worse", None, "worse", False, "less")),
    "tolerated": ([5, 6, 7], [2, 3, 4], [0.9] * 3, [0.9, 0.9, 0.86], ("better", None, "kept", False, "less")),
    "blind": ([5, 6, 7], [2, 3, 4], [0.9] * 3, [0.9, None, 0.9], ("undecided", "no accuracy", "unknown", False, "less")),
    "few": ([5, 6], [2, 3, 4], [0.9] * 2, [0.9] * 3, ("undecided", "too few runs", None, False, "less")),
    "lacking": ([5, None, 7], [2, 3, 4], [0.9] * 3, [0.9] * 3, ("undecided", "a target has no value", None, False, "no value")),
    "more_runs": ([5, 6, 7], [1, 2, 3, 4], [0.9] * 3, [0.9] * 4, ("better", None, "kept", True, "less")),
    "halves_differ": ([5, 6, 7, 8, 9, 10], [2, 3, 4], [0.9] * 6, [0.9] * 3, ("undecided", None, "kept", False, "undecided: base differs")),
    "halves_agree": ([5, 9, 7, 6, 8, 10], [2, 3, 4], [0.9] * 6, [0.9] * 3, ("better", None, "kept", False, "less")),
}


def test_runs_are_compared_by_the_rule_set_beforehand(spark):
    rows = []
    for name, (base, new, base_recall, new_recall, _) in CASES.items():
        for side, costs, recalls in (("base", base, base_recall), ("new", new, new_recall)):
            for i, (cost, recall) in enumerate(zip(costs, recalls, strict=True)):
                rows += [(name, side, i, True, "cost", cost), (name, side, i, True, "recall", recall), (name, side, i, True, "noise", 1.0)]
            rows.append((name, side, 99, False, "cost", 1000.0))
    rows = [(*r[:5], None if r[5] is None else float(r[5])) for r in rows]
    frame = spark.createDataFrame([*rows, ("none", "base", 1, False, "cost", 1.0)], "experiment string, side string, run int, done boolean, metric string, value double")
    out = compare_runs(frame, ["cost"], {"recall": 0.05}, {"noise": 0.5}, 3)
    got = {r["experiment"]: (r["conclusion"], r["reason"], r["accuracy"], r["exploratory"], r["verdicts"]["cost"]) for r in out.collect()}
    assert got.pop("none")[:2] == ("undecided", "too few runs")
    assert got == {name: want for name, (*_, want) in CASES.items()}
    assert compare_runs(frame.limit(0), ["cost"], {}, {}, 3).count() == 0


def test_a_guard_that_rises(spark):
    rows = [("e", side, i, True, m, v) for side, cost, noise in (("base", 5.0, 1.0), ("new", 2.0, 2.0)) for i in range(3) for m, v in (("cost", cost), ("noise", noise))]
    frame = spark.createDataFrame(rows, "experiment string, side string, run int, done boolean, metric string, value double")
    assert [r["conclusion"] for t in (0.5, 1.0) for r in compare_runs(frame, ["cost"], {}, {"noise": t}, 3).collect()] == ["accuracy worse", "better"]
