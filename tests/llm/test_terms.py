from collections import Counter

import pytest

from retromill.llm import terms


def brute(rows, k, share):
    rec = {n: (a, b) for n, a, b, _ in rows if n is not None}
    occ, df = Counter(), Counter()
    for fields in rec.values():
        own = Counter(s.upper()[i : i + k] for s in fields if s for i in range(len(s) - k + 1))
        own = Counter({w: c for w, c in own.items() if not set(w) - set("ACGT")})
        occ += own
        df.update(own.keys())
    mark = lambda n: "rare" if n == 1 else "common" if n > share * len(rec) else "usable"
    return {(w, occ[w], df[w], mark(df[w])) for w in occ}


@pytest.mark.parametrize("k", [2, 6, 10])
@pytest.mark.parametrize("block, held", [(4096, 1 << 23), (7, 1 << 23), (50, 60)])
def test_against_brute_force(make_records, dna, monkeypatch, k, block, held):
    monkeypatch.setattr(terms, "BLOCK", block)
    monkeypatch.setattr(terms, "HELD", held)
    rows = [(f"n{i}", dna(40) + "N" * (i % 3) + dna(5), dna(30).lower() if i % 4 else None, "") for i in range(60)]
    rows += [("p", "A" * 200, "", ""), ("p", "A" * 200, "", ""), (None, "ACGTACGTACGT", "", ""), ("short", "ACG", "N", "")]
    got = [tuple(r) for r in terms.term_frequencies(make_records(rows), k, 0.1).collect()]
    assert set(got) == brute(rows, k, 0.1) and len(got) == len(set(got))


def test_empty(make_records):
    assert terms.term_frequencies(make_records([])).collect() == []
