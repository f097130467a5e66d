import random

from retromill.operators.periods import merge_events, periods_and_gaps


def brute(rows):
    out = set()
    by = {}
    for e, s, t in rows:
        if None not in (e, s, t) and s < t:
            by.setdefault(e, []).append((s, t))
    for e, iv in by.items():
        iv.sort()
        periods = []
        for s, t in iv:
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], t)
            else:
                periods.append([s, t])
        out |= {("period", e, a, b) for a, b in periods}
        out |= {("gap", e, a[1], b[0]) for a, b in zip(periods, periods[1:])}
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "e int, s long, t long, kind string").repartition(5)
    return sorted(tuple(r) for r in periods_and_gaps(df, "e", "s", "t").collect())


def test_random_islands_that_cross_partitions(spark):
    rng = random.Random(1)
    for spread in (50, 400, 5000):
        rows = [(rng.choice([0, 0, 0, 1, 2, -3]), s := rng.randrange(spread), s + rng.randrange(-2, 9), "x") for _ in range(300)]
        rows += [(0, -7, spread, "wide")] if spread == 400 else []
        assert run(spark, rows) == sorted(brute([r[:3] for r in rows]))


def test_nulls_empty_reversed_touching_repeated(spark):
    rows = [(1, 0, 5, None), (1, 0, 5, None), (1, 5, 9, None), (1, 20, 20, None), (1, 30, 10, None), (None, 1, 2, None), (1, None, 3, None), (1, 3, None, None), (2, 1, 2, None)]
    assert run(spark, rows) == sorted([("period", 1, 0, 9), ("period", 2, 1, 2)])


def test_large_coordinates(spark):
    far = 2**61
    rows = [(1, -far, -far + 2, None), (1, far, far + 5, None), (2, -far, far, None), (3, far, far + 1, None)]
    assert run(spark, rows) == sorted(brute([r[:3] for r in rows]))


def test_empty(spark):
    assert run(spark, []) == []


def test_units(spark):
    df = spark.createDataFrame([(1, 0, 10, 3), (1, 20, 30, 4), (1, 25, 40, 5), (2, 0, 4, None)], "e int, s long, t long, u long")
    got = sorted(tuple(r) for r in merge_events(df, "e", "s", "t", "u").collect())
    assert got == [(1, 0, 10, 3), (1, 20, 40, 0), (2, 0, 4, 0)]
