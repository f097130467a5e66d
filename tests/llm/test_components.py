import random

from retromill import shared
from retromill.llm.components import hash_to_min, linked_records
from retromill.shared import materialize


def brute(pairs):
    group = {}
    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
        if ga is not gb:
            ga |= gb
            for x in gb:
                group[x] = ga
    return sorted((min(g), x) for x, g in group.items())


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return sorted(tuple(r) for r in hash_to_min(df, "a", "b").select("group_name", "name").collect())


def test_chains_stars_random(spark):
    rng = random.Random(2)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    pairs += [(f"s{i:03}", "s999") for i in range(30)]
    pairs += [(f"r{rng.randrange(80)}", f"r{rng.randrange(80)}") for _ in range(60)]
    rng.shuffle(pairs)
    assert run(spark, pairs) == brute(pairs)


def test_dirty(spark):
    pairs = [("a", "a"), (None, "b"), ("b", None), (None, None), ("x", "y"), ("y", "x"), ("x", "y"), ("é", "z"), ("Z", "z")]
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == []


def test_only_known_names(spark, make_records):
    pairs = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "gone", "x"), ("gone", "d", "x")], "name_a string, name_b string, v string")
    got = linked_records(pairs, make_records([(n, "", "", "") for n in "aabcd"] + [(None, "", "", "")]))
    assert sorted(tuple(r) for r in got.select("group_name", "name").collect()) == [("a", "a"), ("a", "b"), ("a", "c")]


def test_a_giant_group_beside_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(shared, "FEW", 10_000)  # its keys are hot, and broadcast
    n = 12_000
    df = spark.range(n).selectExpr("'hub' as a", "concat('n', id) as b")
    got, facts = materialize(hash_to_min(df, "a", "b"))
    assert got.count() == n + 1 and got.select("group_name").distinct().count() == 1
