import random
from collections import defaultdict

from pyspark.sql import functions as F

from retromill.operators import seeds


def sequences():
    rng = random.Random(3)
    new = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    hot, rows = new(30), []
    for f in range(6):
        base = new(120)
        for _ in range(10):
            s = list(base)
            for _ in range(6):
                s[rng.randrange(len(s))] = rng.choice("ACGTN")
            s = hot + "".join(s)
            rows.append(s if rng.random() < 0.6 else s.translate(str.maketrans("ACGT", "TGCA"))[::-1])
    return [*enumerate(rows), (900, None), (901, "ACGT"), (902, hot[:11])]


def words(s):
    out = set()
    for i in range(len(s or "") - 11):
        w = s[i : i + 12]
        if not set(w) - set("ACGT"):
            out.add(min(w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1]))
    return out


def test_a_word_in_every_sequence_is_no_seed(spark):
    """Words that all sequences have are counted in the tasks and never leave them."""
    rows, cap = sequences(), 20
    df = spark.createDataFrame(rows, "id long, seq string")
    holders = defaultdict(list)
    for i, s in rows:
        for w in words(s):
            holders[w].append(i)
    assert max(map(len, holders.values())) == 60
    want = defaultdict(int)
    for w, ids in holders.items():
        if 2 <= len(ids) <= cap:
            for a in ids:
                for b in ids:
                    if a < b:
                        want[a, b] += 1
    among = seeds.usable_words(seeds.word_counts(df, "id", "seq"), cap)
    got = {(r.i, r.j): r.n for r in seeds.pair_counts(df, among).collect()}
    assert got == want
    assert seeds.postings(df, "id", "seq", 12, among).groupBy("word").count().agg(F.max("count")).first()[0] <= cap


def test_known_pairs_have_the_anchors_of_all_events(spark):
    df = spark.createDataFrame(sequences(), "id long, seq string")
    events = seeds.shared_words(df, "id", "seq", 20)
    want = sorted(tuple(r) for r in seeds.anchored_pairs(events, 3).collect())
    among = seeds.usable_words(seeds.word_counts(df, "id", "seq"), 20)
    pairs = seeds.pair_counts(df, among).select("i", "j")
    for side in "ij":
        pairs = pairs.join(df.select(F.col("id").alias(side), F.col("seq").alias(f"s{side}")), side)
    got = seeds.anchored(pairs, "si", "sj", among, 3).select("i", "j", "n_shared", "is_rc", "pi", "pj")
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_no_sequences(spark):
    df = spark.createDataFrame([], "id long, seq string")
    among = seeds.usable_words(seeds.word_counts(df, "id", "seq"), 20)
    assert not among.any() and seeds.pair_counts(df, among).collect() == []
    assert seeds.anchored_pairs(seeds.shared_words(df, "id", "seq", 20)).collect() == []


def test_long_sequences_are_searched_by_a_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    new = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, unit = new(300), new(40)
    turned = a.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = [(1, a + new(500) + a), (2, a + "N" + new(400) + turned), (3, unit * 12), (4, None), (5, "ACGT"), (6, new(200))]
    df = spark.createDataFrame(rows, "id long, seq string")
    for how in ({}, {"inverted": True}, {"least": 2, "most": 100, "width": 1}, {"over": True}, {"over": True, "inverted": True}, {"over": True, "least": 50, "most": 90, "width": 1}):
        monkeypatch.setattr(seeds, "WHOLE", 1 << 22)
        want = sorted(tuple(r) for r in seeds.repeat_diagonals(df, "id", "seq", **how).collect())
        monkeypatch.setattr(seeds, "WHOLE", 150)
        assert want and sorted(tuple(r) for r in seeds.repeat_diagonals(df, "id", "seq", **how).collect()) == want


def test_words_that_recur_nearby_are_paired_with_the_next_far_enough(spark):
    rng = random.Random(6)
    new = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    near = new(60)
    seq = near + near + new(300) + near + new(30)
    df = spark.createDataFrame([(1, seq), (2, None), (3, ""), (4, "ACGTNNNN"), (5, seq), (5, seq[:20])], "id long, seq string")
    want = {}
    for a in range(len(seq) - 11):
        for b in range(a + 200, min(a + 501, len(seq) - 11)):
            if seq[a : a + 12] == seq[b : b + 12]:
                n, first, last = want.get(b - a, (0, a, a))
                want[b - a] = (n + 1, min(first, a), max(last, a))
                break
    found = seeds.repeat_diagonals(df, "id", "seq", least=200, most=500, width=1, over=True).where("id = 1").collect()
    assert {(r["diagonal"], (r["n_words"], r["first_pos"], r["last_pos"])) for r in found} == {(d, x) for d, x in want.items() if x[0] >= 10} and len(found) == 2
    plain = seeds.repeat_diagonals(df, "id", "seq", least=200, most=500, width=1).where("id = 1").collect()
    assert len(plain) == 1
