import random

import pytest

from retromill.llm import neardup


def words(fields):
    flip = str.maketrans("ACGT", "TGCA")
    out = set()
    for s in fields:
        s = (s or "").upper()
        for i in range(len(s) - 11):
            w = s[i : i + 12]
            if not set(w) - set("ACGT"):
                out.add(min(w, w.translate(flip)[::-1]))
    return out


def brute(rows, share):
    rec = {n: words(f) for n, *f in rows if n is not None}
    names = sorted(rec)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rec[a] | rec[b] and len(rec[a] & rec[b]) >= share * len(rec[a] | rec[b])}


def family(dna, rng, n, edits, tag):
    parts = [dna(150), dna(500), dna(150)]
    for i in range(n):
        own = []
        for p in parts:
            p = list(p)
            for _ in range(edits):
                at = rng.randrange(len(p))
                p[at] = rng.choice(["", "A", "CG", "T", "N"])
            own.append("".join(p))
        if i % 3 == 0:
            own = [s.translate(str.maketrans("ACGT", "TGCA"))[::-1] for s in own[::-1]]
        yield (f"{tag}{i}", *own)


def cases(dna):
    rng = random.Random(8)
    rows = [*family(dna, rng, 12, 2, "a"), *family(dna, rng, 12, 9, "b"), *family(dna, rng, 6, 25, "c")]
    copy = rows[3]
    rows += [("copy1", *copy[1:]), ("copy2", *copy[1:]), copy, ("low", *(s.lower() for s in copy[1:]))]
    rows += [("none", "", None, "ACGTNNNNACGT"), ("empty", None, None, None), (None, *copy[1:]), ("one", "ACGTACGTACGA", "", ""), ("two", "ACGTACGTACGAC", None, ""), ("same", "ACGTACGTACGA", "", "")]
    return rows


@pytest.mark.parametrize("probes", [neardup.PROBES, None])
@pytest.mark.parametrize("block", [256, 4])
def test_against_brute_force(make_records, dna, monkeypatch, block, probes):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "COPIES", 1000 if block == 256 else 2)
    rows = cases(dna)
    got = [tuple(r) for r in neardup.similar_pairs(make_records(rows), probes=probes).collect()]
    assert set(got) == brute(rows, 0.5) and len(got) == len(set(got))


def test_bound_drops_unlike_pairs_only(spark, sf, monkeypatch):
    """On the tables the segment counts drop candidates, and none that is alike."""
    seen, real = spark.sparkContext.accumulator(0), neardup._bounded
    kept = spark.sparkContext.accumulator(0)

    def counted(share):
        def over(batches):
            def tally(b):
                for x in b:
                    seen.add(x.num_rows)
                    yield x

            for y in real(share)(tally(batches)):
                kept.add(y.num_rows)
                yield y

        return over

    records = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/ltr_records.parquet")
    monkeypatch.setattr(neardup, "_bounded", counted)
    found = neardup.similar_pairs(records).count()
    assert found and 0 < kept.value < seen.value


def test_packing_round_trip(dna):
    import numpy as np

    from retromill.functions.dna import CODES

    for s in ("", "ACGT", dna(50) + "N" + dna(11) + "NN" + dna(12), dna(37)):
        codes = CODES[np.frombuffer(s.encode(), np.uint8)]
        back, runs, rows = neardup._unpack_runs([neardup._pack_runs(codes, np.zeros(0, np.int64))])
        text = "".join("ACGT"[c] for c in back)
        kept = [text[a:b] for a, b in zip(runs, runs[1:])][:-1]
        assert kept == [r for r in s.replace("N", " ").split() if len(r) >= 12] and rows[-1] == len(back)


def test_empty(make_records):
    assert neardup.similar_pairs(make_records([])).collect() == []
