import random

from pyspark.sql import functions as F

from retromill.operators import coordinates as co
from retromill.operators.periods import merge_events


def make(spark, seed, unit=True):
    rng = random.Random(seed)
    seqs = {e: "".join(rng.choice("ACGT") for _ in range(n)) for e, n in ((0, 400), (1, 150), (2, 30))}
    events = []
    for e, s in seqs.items():
        for _ in range(len(s) // 25 if e != 2 else 0):
            a = rng.randrange(len(s) - 1)
            b = min(len(s), a + 1 + rng.randrange(20))
            events.append((e, a, b, rng.randrange(0, 4) if unit else 0))
    sdf = spark.createDataFrame(list(seqs.items()), "entity long, seq string")
    edf = spark.createDataFrame(events, "entity long, orig_start long, orig_end long, unit_len long")
    return seqs, sdf, edf


def kept(seq, spec):
    keep = [True] * len(seq)
    for a, b, u in spec:
        for i in range(min(b, a + u), b):
            keep[i] = False
    return keep


def test_collapse_reconstruct_lift(spark):
    for seed in (1, 2, 3):
        seqs, sdf, edf = make(spark, seed)
        spec = {}
        for r in merge_events(edf, "entity", "orig_start", "orig_end", "unit_len").collect():
            spec.setdefault(r.entity, []).append((r.orig_start, r.orig_end, r.unit_len))
        small = co.collapse_sequences(sdf, edf)
        want = {e: "".join(c for c, k in zip(s, kept(s, spec.get(e, []))) if k) for e, s in seqs.items()}
        assert {r.entity: r.seq for r in small.collect()} == want
        assert {r.entity: r.seq for r in co.reconstruct(small, co.removed_pieces(sdf, edf)).collect()} == seqs
        points = spark.createDataFrame([(e, i) for e, s in want.items() for i in range(len(s))], "entity long, pos long")
        up = {(r.entity, r.pos): r.lifted for r in co.lift(points, edf, back=False).collect()}
        for e, s in seqs.items():
            assert [up[e, i] for i in range(len(want[e]))] == [i for i, k in enumerate(kept(s, spec.get(e, []))) if k]
        back = co.lift(co.lift(points, edf, back=False).select("entity", F.col("pos").alias("was"), F.col("lifted").alias("pos")), edf, back=True)
        assert back.where("was <> lifted").count() == 0
        info = {r.entity: (r.orig_len, r.short_len) for r in co.map_info(edf, sdf.select("entity", F.length("seq").cast("long").alias("len"))).collect()}
        assert info == {e: (len(s), len(want[e])) for e, s in seqs.items()}


def test_chained_maps_equal_two_steps(spark):
    for seed in (4, 5):
        seqs, sdf, first = make(spark, seed, unit=False)
        once = co.collapse_sequences(sdf, first)
        second = spark.createDataFrame([(0, 10, 25, 0), (0, 60, 61, 0), (1, 5, 20, 0)], "entity long, orig_start long, orig_end long, unit_len long")
        twice = {r.entity: r.seq for r in co.collapse_sequences(once, second).collect()}
        assert {r.entity: r.seq for r in co.collapse_sequences(sdf, co.chain(first, second)).collect()} == twice


def test_numbers_and_running_sums(spark):
    df = spark.createDataFrame([(k % 3, k * 7, k % 5) for k in range(200)], "key long, ord long, v long").repartition(7)
    got = {r.ord: r.ordinal for r in co.number_rows(df, "ord").collect()}
    assert got == {k * 7: k + 1 for k in range(200)}
    sums = {(r.key, r.ord): r.before for r in co.running_sum(df, "key", "ord", "v", "before", 50).collect()}
    for key in range(3):
        total = 0
        for k in range(200):
            if k % 3 == key:
                assert sums[key, k * 7] == total
                total += k % 5


def test_overlap_semi_join(spark):
    rng = random.Random(3)
    a = [(rng.randrange(2), x := rng.randrange(2000), x + rng.randrange(-1, 300)) for _ in range(150)] + [(None, 1, 2), (1, None, 5)]
    b = [(rng.randrange(2), x := rng.randrange(2000), x + rng.randrange(0, 40)) for _ in range(40)]
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "id int, k int, s long, e long")
    right = spark.createDataFrame(b, "k int, a long, b long")
    got = {r.id for r in co.overlapping(left, right, "k", "s", "e", "a", "b", width=64).collect()}
    want = {i for i, (k, s, e) in enumerate(a) if k is not None and s is not None and s < e and any(k == q and x < y and s < y and x < e for q, x, y in b)}
    assert got == want


def test_masks(spark):
    s = spark.createDataFrame([(0, "acgtacgtac"), (1, "ACGT"), (2, "")], "entity long, seq string")
    e = spark.createDataFrame([(0, 0, 2, 0), (0, 4, 6, 1), (0, 6, 7, 1), (0, 9, 99, 0), (2, 5, 9, 0)], "entity long, orig_start long, orig_end long, unit_len long")
    assert {r.entity: r.seq for r in co.mask_sequences(s, e).collect()} == {0: "NNGTNNNTAN", 1: "ACGT", 2: ""}
    assert {r.entity: r.seq for r in co.mask_sequences(s, e, soft=True).collect()} == {0: "acGTacgTAc", 1: "ACGT", 2: ""}


def test_rounds_are_lifted_through_their_own_maps(spark, tmp_path):
    from retromill.queries.intervals import lift_through_rounds

    # round 1 takes out 20-60 but for 10, round 2 then 50-80 but for 5, in the positions that round 1 left
    rows = [(1, 20, 30, 50, 60, 1), (2, 50, 55, 75, 80, 2), (3, 10, 12, 14, 16, 3), (4, 40, 42, 44, 46, 3), (5, 90, 92, 94, 96, 3)]
    df = spark.createDataFrame(rows, "aln_id long, r1s long, r1e long, r2s long, r2e long, round int").selectExpr("*", "0 as scaffold_idx", "timestamp'2020-01-01' as loaded_at")
    df.write.parquet(f"{tmp_path}/ltr_aligns.parquet")
    got = {r.aln_id: r.lifted for r in lift_through_rounds(spark, str(tmp_path)).collect()}
    assert got == {1: 20, 2: 80, 3: 10, 4: 70, 5: 145}
