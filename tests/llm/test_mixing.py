from retromill.llm.mixing import budgets, mix

TARGETS = "source string, target_share double, max_repeats int, n int"


def run(spark, rows, targets):
    sizes = spark.createDataFrame([(*r, "x") for r in rows], "doc long, source string, n_tokens long, h string")
    used, report = mix(sizes, "doc", spark.createDataFrame([(*t, 1) for t in targets], TARGETS))
    return {r.doc: r for r in used.collect()}, {r.source: r for r in report.collect()}


def test_shares_and_repeats(spark):
    rows = [(i, "Big One" if i % 2 else " big-one", 100 + i % 7) for i in range(2000)] + [(5000 + i, "small", 50) for i in range(40)] + [(9000, None, 10), (9001, "other", 10), (9002, "small", 0), (9003, "small", None)]
    used, report = run(spark, rows, [("big one", 0.8, 1), ("small", 0.2, 4), ("absent", 0.0, 2)])
    assert not {9000, 9001, 9002, 9003} & set(used)
    assert max(r.repeats for r in used.values() if r.source == "big_one") == 1
    assert {r.repeats for r in used.values() if r.source == "small"} == {4}
    assert abs(report["big_one"].actual_share - 0.8) < 0.01 and abs(report["small"].actual_share - 0.2) < 0.01
    assert report["absent"].actual_share == 0 and report["absent"].most_repeats == 0
    for s in ("big_one", "small"):
        assert report[s].n_tokens == sum(r.n_tokens * r.repeats for r in used.values() if r.source == s)


def test_a_threshold_misses_less_than_one_item(spark):
    rows = [(i, "a", 1 + i % 50) for i in range(3000)] + [(10_000 + i, "b", 10) for i in range(100)]
    used, report = run(spark, rows, [("a", 0.5, 1), ("b", 0.5, 3)])
    want = budgets({"a": sum(r[2] for r in rows if r[1] == "a"), "b": 1000}, {"a": (0.5, 1), "b": (0.5, 3)})
    for s in "ab":
        assert 0 <= want[s] - report[s].n_tokens <= 50


def test_one_item_sources_empty_and_null_targets(spark):
    used, report = run(spark, [(1, "a", 100), (2, "b", 7)], [("a", 0.5, 1), ("b", 0.5, 2), ("b", 0.9, 9), (None, 0.1, 1), ("c", None, None)])
    assert used[2].repeats == 2 and 1 not in used and report["a"].n_tokens == 0
    used, report = run(spark, [], [("a", 1.0, 1)])
    assert not used and report["a"].actual_share == 0
    used, report = run(spark, [(1, "a", 5)], [])
    assert not used and not report


def test_quotes_in_names(spark):
    used, report = run(spark, [(i, "it's \\ x", 10) for i in range(600)] + [(1000 + i, "b", 10) for i in range(100)], [("it's \\ x", 0.5, 1), ("b", 0.5, 1)])
    assert abs(report["b"].actual_share - 0.5) < 0.02
