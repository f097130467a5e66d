import random

import numpy as np
from pyspark.sql import functions as F

from retromill.config import Thresholds
from retromill.operators import alignment as al
from retromill.operators import consensus as cs
from retromill.operators import graph


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def mutated(rng, s, n):
    s = list(s)
    for _ in range(n):
        s[rng.randrange(len(s))] = rng.choice(["", "A", "C", "GT", "T"])
    return "".join(s)


def bounded(a, b, budget):
    budget = budget if budget > 0 else max(len(a), len(b)) // 4 + 1
    d = lev(a, b) if a and b else -1
    return d if 0 <= d <= budget else -1


def brute(a, b, pi, pj, rc):
    if rc:
        b = b.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        pj = len(b) - pj - 12
    if not a or not b or np.float32(min(len(a), len(b)) / max(len(a), len(b))) < np.float32(0.8):
        return None
    lmax = max(len(a), len(b))
    budget = int(lmax * 0.25) + 1
    if pi <= 0 or pj <= 0:
        d = bounded(a, b, budget)
        return None if d < 0 else d
    pi, pj = min(pi, len(a)), min(pj, len(b))
    right, left = max(len(a) - pi, len(b) - pj), max(pi, pj)
    br = budget * right // (right + left) + 1
    dr, dl = bounded(a[pi:], b[pj:], br), bounded(a[:pi], b[:pj], max(budget - br, 0))
    return None if dr < 0 or dl < 0 else dr + dl


def test_anchored_pairs_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 90)))
        b = mutated(rng, a, rng.choice([0, 2, 5, 12, 30]))
        rc = rng.random() < 0.4
        if rc:
            b = b.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        rows.append((i, a, b, rng.choice([0, -1, 5, 10, 500, len(a) // 2]), rng.choice([0, 5, 10, len(b) // 2, 500]), rc))
    rows += [(500, "", "ACGT", 0, 0, False), (501, "ACGT", "", 1, 1, True), (502, "A" * 80, "A" * 100, 0, 0, False), (503, "A" * 79, "A" * 100, 0, 0, False)]
    df = spark.createDataFrame(rows, "id int, a string, b string, pi int, pj int, is_rc boolean")
    got = {r.id: r.edits for r in al.verify(df, "a", "b").collect()}
    assert got == {i: brute(a, b, pi, pj, rc) for i, a, b, pi, pj, rc in rows}


def test_matching_flanks_remove_edges(spark):
    rng = random.Random(2)
    f = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    x, y = f(100), f(100)
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    el = [(0, x, y), (1, mutated(rng, x, 5), f(100)), (2, f(100), rc(y)), (3, f(100), f(100)), (4, x, y[:49]), (5, "", None)]
    e = spark.createDataFrame([(0, j, 0.9) for j in range(1, 6)], "i long, j long, ltr_ident double")
    kept = al.flank_filter(e, spark.createDataFrame(el, "elem long, flank_l string, flank_r string"))
    assert sorted(r.j for r in kept.collect()) == [3, 4, 5]


def test_cigars_and_rows(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(5, 60)))
        rows.append((i, a, mutated(rng, a, rng.choice([0, 1, 4, 9])) or "A"))
    rows += [(90, "", "A"), (91, None, "A"), (92, "AAAAAAAA", "CCCCCCCC")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = cs.aligned_rows(cs.align_pairs(df, "a", "b", 0.5), "b", "cigar").collect()
    for r in got:
        if r.id in (90, 91, 92):
            assert r.cigar is None and r.row is None
            continue
        assert r.edits == lev(r.a, r.b)
        i = j = cost = 0
        row = ""
        for n, op in __import__("re").findall(r"(\d+)([MDI])", r.cigar):
            n = int(n)
            if op == "M":
                cost += sum(x != y for x, y in zip(r.a[i : i + n], r.b[j : j + n]))
                row += r.b[j : j + n]
                i, j = i + n, j + n
            elif op == "D":
                row, i, cost = row + "-" * n, i + n, cost + n
            else:
                j, cost = j + n, cost + n
        assert (i, j, cost) == (len(r.a), len(r.b), r.edits) and row == r.row and len(row) == len(r.a)


def test_consensus_recovers_the_ancestor(spark):
    rng = random.Random(12)
    a = "".join(rng.choice("ACGT") for _ in range(200))
    rows = [("f", f"m{i}", mutated(rng, a, 4) if i else a, "m0") for i in range(9)]
    rows[4] = (*rows[4][:2], rows[4][2].translate(str.maketrans("ACGT", "TGCA"))[::-1], "m0")
    rows += [("g", "x", "", "x"), ("g", "y", None, "x")]
    got = cs.star_consensus(spark.createDataFrame(rows, "family string, member string, seq string, centroid string")).collect()
    assert len(got) == 1 and got[0].n == 9 and lev(got[0].seq, a) <= 2


def test_target_sites(spark):
    rows = [("f", "TTTACGTA", "ACGTAGGG"), ("f", "GGGACGTA", "ACGTACCC"), ("f", "CCCCCCCC", "GGGGGGGG"), ("f", None, "A"), ("f", "AG", ""), ("g", "AC", "AC"), ("g", "TTNC", "NCAA"), ("h", "A", "T")]
    got = {r.family: tuple(r)[1:] for r in cs.target_site(spark.createDataFrame(rows, "family string, l string, r string"), "family", "l", "r").collect()}
    assert got == {"f": (3, 5, 2, 0.67, "ACGTA"), "g": (2, 2, 2, 1.0, "AC"), "h": (1, 0, 0, 0.0, "")}


def test_components_and_families(spark):
    rng = random.Random(3)
    pairs = [(f"c{i:02}", f"c{i + 1:02}") for i in range(40)] + [("x", "y"), ("p", "q"), ("q", "r"), ("r", "r"), (None, "z"), ("z", None)] + [(f"h{i}", "hub") for i in range(30)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.node: r.component for r in graph.components(df, "a", "b").collect()}
    want = {f"c{i:02}": "c00" for i in range(41)} | {"x": "x", "y": "x", "p": "p", "q": "p", "r": "p"} | {f"h{i}": "h0" for i in range(30)} | {"hub": "h0"}
    assert got == want
    fam = graph.families(df, "a", "b")
    assert {(r.family, r.member) for r in fam.where("member in ('c07', 'hub', 'q', 'x')").collect()} == {(1, "c07"), (2, "hub"), (3, "q")}
    assert {r.centroid for r in graph.centroids(fam, graph.degrees(df, "a", "b")).collect()} == {"c01", "hub", "q"}
    assert graph.components(df.where("false"), "a", "b").collect() == []


def test_a_hub_with_very_many_neighbours(spark):
    n = 11_000
    df = spark.range(n).selectExpr("'hub' as a", "concat('n', id) as b")
    got = graph.components(df, "a", "b")
    assert got.count() == n + 1 and got.select("component").distinct().count() == 1


def test_subfamilies(spark):
    e = [("a", "b", 0.1), ("b", "c", 0.3), ("c", "d", 0.2), ("d", "e", None), ("x", "y", 0.0), ("y", "z", 0.0)]
    df = spark.createDataFrame(e, "p string, q string, dist double")
    got = graph.subfamilies(df, "p", "q", "dist", graph.families(df, "p", "q")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", "a"), (1, "a", "b"), (1, "b", "c"), (1, "b", "d"), (2, "", "x"), (2, "", "y"), (2, "", "z")]


def test_subfamily_letters(spark):
    df = spark.range(60).select(cs.subfamily_tag(F.col("id")).alias("t"))
    assert [r.t for r in df.collect()] == [chr(97 + i % 26) * (i // 26 + 1) for i in range(60)]


def test_thresholds_are_the_80_80_80_rule():
    t = Thresholds()
    assert (t.min_identity, t.min_coverage, t.min_ltr_len) == (0.8, 0.8, 80)


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_bit_tables_cut_into_blocks_give_the_same_traces(monkeypatch):
    rng = random.Random(21)
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 60)))
        b = mutated(rng, a, rng.randrange(20)) or "A"
        monkeypatch.setattr(cs, "BLOCK", 4096)
        whole, strands = cs._steps(a, b, 99), cs._either_strand(a, rc(b), 99)
        monkeypatch.setattr(cs, "BLOCK", 7)
        assert whole[0] == lev(a, b) and cs._steps(a, b, 99) == whole
        assert strands[1][0] == min(lev(a, b), lev(a, rc(b))) and strands[0] == (lev(a, b) < lev(a, rc(b)))
        assert cs._least_edits(a, b) <= lev(a, b) and cs._steps(a, b, lev(a, b) - 1) is None


def test_star_consensus_of_whole_elements(spark, tmp_path):
    from retromill.queries.families import star_consensus

    rng = random.Random(31)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a = letters(420)
    seqs = {"a": "", "b": a, "c": rc(mutated(rng, a, 4)), "d": mutated(rng, a, 4), "e": mutated(rng, a, 4), "f": letters(420)}
    # "a" has most links, but no sequence; "f" is like no other; left repeats are the first 90 bases only, or null
    rows = [(n, s, s[:90] if n != "b" else None) for n, s in seqs.items()]
    spark.createDataFrame(rows, "name string, full_seq string, ltr5 string").selectExpr("*", "timestamp'2020-01-01' as loaded_at").write.parquet(f"{tmp_path}/ltr_records.parquet")
    spark.createDataFrame([("a", x) for x in "bcdef"] + [("b", x) for x in "cde"], "name_a string, name_b string").write.parquet(f"{tmp_path}/match_pairs.parquet")
    got = star_consensus(spark, str(tmp_path)).collect()
    assert [(r.n, r.n_failed) for r in got] == [(4, 2)]
    assert len(got[0].seq) > 380 and lev(got[0].seq, a) <= 15  # the ends up to a conserved run are trimmed


def test_whole_members_of_a_consensus(spark, tmp_path):
    from retromill.queries import families as q

    rng = random.Random(41)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a = letters(300)
    put = lambda s, i, x: s[:i] + x + s[i + 1 :]
    change = lambda s, i: put(s, i, "C" if s[i] == "A" else "A")
    # one more base near the beginning, the other strand, a changed base behind the sixtieth, a left repeat of 20 bases
    seqs = {"a": a, "b": a[:5] + "T" + a[5:], "c": rc(change(a, 150)), "d": change(a, 200), "e": change(a, 250), "f": letters(300), "g": ""}
    rows = [(n, s, s[:20]) for n, s in seqs.items()]
    spark.createDataFrame(rows, "name string, full_seq string, ltr5 string").selectExpr("*", "timestamp'2020-01-01' as loaded_at").write.parquet(f"{tmp_path}/ltr_records.parquet")
    spark.createDataFrame([("a", x) for x in "bcdefg"], "name_a string, name_b string").write.parquet(f"{tmp_path}/match_pairs.parquet")
    spark.createDataFrame([("k", x) for x in [*seqs, "a"]], "consensus string, member string").write.parquet(f"{tmp_path}/members.parquet")
    d = str(tmp_path)
    assert [tuple(r) for r in q.aligned_consensus(spark, d).collect()] == [("k", 5, 2, a)]
    want = {i: (0.8 if i in (150, 200, 250) else 1.0, 1.0) for i in range(300)}
    assert {r.col: (r.conservation, r.saturation) for r in q.aligned_conservation(spark, d).collect()} == want
    assert [tuple(r) for r in q.aligned_bounds(spark, d).collect()] == [("k", 0, 299)]
    assert [tuple(r) for r in q.aligned_trim(spark, d).collect()] == [("k", a)]


def test_column_counts_against_brute_force(spark, monkeypatch):
    from collections import Counter

    rng = random.Random(7)
    rows = [(rng.choice("xyz"), "".join(rng.choice("ACGTacgtN-") for _ in range(rng.randrange(40)))) for _ in range(200)] + [("x", None), (None, "AC")]
    want = {}
    for f, s in rows:
        for i, x in enumerate(s or ""):
            want.setdefault((f, i), Counter())[x.upper()] += 1
    monkeypatch.setattr(cs, "HELD_COLUMNS", 50)
    got = cs.column_counts(spark.createDataFrame(rows, "f string, s string").repartition(3), "f", "s").collect()
    assert {(r.family, r.col): (r.a, r.c, r.g, r.t) for r in got} == {k: tuple(c[b] for b in "ACGT") for k, c in want.items()}


def test_requested_subsequences(spark):
    from retromill.operators import stats

    seqs = spark.createDataFrame([("x", "ACGTACGT"), ("y:z", "TTGA")], "name string, seq string")
    asked = ["x:0-3", "x:0-3", "x:6-99", "x:3-3", "x:5-2", "y:z:1-3", "w:0-1", "x", "x:-1-3", "x:2-99999999999", None]
    got = stats.subsequences(seqs, spark.createDataFrame([(r,) for r in asked], "request string")).collect()
    assert {r.request: r.part for r in got} == {"x:0-3": "acg", "x:6-99": "gt", "x:3-3": "", "x:5-2": "", "y:z:1-3": "tg", "w:0-1": None, "x": None, "x:-1-3": None, "x:2-99999999999": "gtacgt"} and len(got) == 9


def expanded(cons, captured):
    """Rows with insertion columns, column by column, and the cap on their number by trial."""
    steps = lambda c: [(int(n), op) for n, op in __import__("re").findall(r"(\d+)([MDI])", c)]
    ins = [0] * (len(cons) + 1)
    for _, cigar in captured:
        at = 0
        for n, op in steps(cigar):
            if op == "I":
                ins[at] = max(ins[at], n)
            else:
                at += n
    cap = max(ins)
    while sum(min(v, cap) for v in ins) > len(cons):
        cap -= 1
    ins = [min(v, cap) for v in ins]
    rows = []
    for seq, cigar in [(cons, f"{len(cons)}M"), *captured]:
        cells, own, at, loc = ["-"] * len(cons), [""] * (len(cons) + 1), 0, 0
        for n, op in steps(cigar):
            if op == "M":
                cells[at : at + n] = seq[loc : loc + n]
            if op == "I":
                own[at] = seq[loc : loc + n]
            at, loc = at + n * (op != "I"), loc + n * (op != "D")
        rows.append(("".join(o[:w].ljust(w, "-") + c for o, w, c in zip(own, ins, [*cells, ""])), sum(max(0, len(o) - w) for o, w in zip(own, ins))))
    return rows


def test_alignments_to_the_consensus_against_brute_force(spark):
    rng = random.Random(51)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a = letters(120)
    wide = lambda at, n: a[:at] + letters(n) + a[at:]
    families = {
        1: {"m1": a[:40] + "TTT" + a[40:], "m2": rc(a[:40] + "TTTTT" + a[45:]), "m3": mutated(rng, a, 9), "m4": "G" * 7 + a + "CC", "m5": letters(300), "m6": ""},
        2: {"w1": wide(30, 100), "w2": rc(wide(80, 90)), "w3": wide(100, 5)},
        3: {"x1": a},
    }
    rows = [(f, m, s) for f, members in families.items() for m, s in members.items()]
    cons = spark.createDataFrame([(1, a), (2, a)], "family long, cseq string")
    got = cs.consensus_rows(spark.createDataFrame(rows, "family long, member string, seq string"), cons).collect()
    assert len(got) == len(rows) + 2
    assert sorted(r.member for r in got if r.row is None) == ["m5", "m6", "x1"]
    assert {r.member for r in got if r.is_rc} == {"m2", "w2"}
    for f in (1, 2):
        ok = [r for r in got if r.family == f and r.row is not None]
        mine = sorted((r for r in ok if r.ord), key=lambda r: r.member)
        turned = [rc(families[f][r.member]) if r.is_rc else families[f][r.member] for r in mine]
        assert [r.edits for r in mine] == [lev(a, s) for s in turned]
        want = expanded(a, [(s, r.cigar) for s, r in zip(turned, mine)])
        assert [(r.row, r.n_cut) for r in [*(r for r in ok if not r.ord), *mine]] == want
        assert (f == 2) == any(n for _, n in want)
