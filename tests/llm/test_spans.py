import pytest

from retromill.llm import spans


def brute(rows, size):
    rec = {}
    for n, a, b, _ in rows:
        if n is not None:
            rec[n] = ((a or "").upper(), (b or "").upper())
    own = {}
    for n, fields in rec.items():
        for s in fields:
            for i in range(len(s) - size + 1):
                own.setdefault(s[i : i + size], set()).add(n)
    out = set()
    for n, fields in rec.items():
        for f, s in zip(("ltr5", "internal"), fields):
            cover = [0] * len(s)
            for i in range(len(s) - size + 1):
                w = s[i : i + size]
                if not set(w) - set("ACGT") and len(own[w]) > 1:
                    cover[i : i + size] = [1] * size
            if sum(cover):
                out.add((n, f, sum(cover)))
    return out


@pytest.mark.parametrize("limit", [20_000, 1])
def test_against_brute_force(make_records, dna, limit):
    x, y, z = dna(200), dna(150), dna(90)
    rows = [("a", x, dna(50) + y + dna(30), ""), ("b", dna(20) + x[30:140] + dna(20) + x[120:], y[:79], ""), ("c", y[:80].lower(), x[:100] + "N" + x[101:], ""), ("c", y[:80].lower(), x[:100] + "N" + x[101:], ""), ("d", z + dna(10) + z, None, ""), ("e", "", "ACG", ""), (None, x, y, "")]
    rows += [(f"p{i}", "A" * 300, "AC" * 100, "") for i in range(20)]
    got = spans.shared_spans(make_records(rows), 80, limit).collect()
    assert {tuple(r) for r in got} == brute(rows, 80) and len(got) == len(brute(rows, 80))


@pytest.mark.parametrize("most", [spans.MOST_BROADCAST, 0])
def test_hot_anchors_take_the_other_way(spark, make_records, dna, monkeypatch, most):
    monkeypatch.setattr(spans, "MOST_BROADCAST", most)
    x = dna(300)
    rows = [(f"n{i}", x[: 100 + i % 50], dna(100), "") for i in range(120)]
    real, used = spans._hot_intervals, []
    monkeypatch.setattr(spans, "_hot_intervals", lambda *a: used.append(1) or real(*a))
    got = spans.shared_spans(make_records(rows), 80, 1)
    assert {tuple(r) for r in got.collect()} == brute(rows, 80) and used


def test_an_anchor_in_all_records_at_the_default_limit(spark, make_records, dna, monkeypatch):
    x, n = dna(90), 24_000
    real, used, sizes = spans._hot_intervals, [], spark.sparkContext.accumulator(0)
    whole = spans.whole_groups

    def watched(batches, *keys):
        for b in whole(batches, *keys):
            sizes.add(b.num_rows if b.num_rows > 2 * spans.IN_ONE_TASK else 0)
            yield b

    monkeypatch.setattr(spans, "_hot_intervals", lambda *a: used.append(1) or real(*a))
    monkeypatch.setattr(spans, "whole_groups", watched)
    rows = [(f"n{i}", x, dna(40), "") for i in range(n)]
    got = spans.shared_spans(make_records(rows), 80)
    assert {(r.field, r.shared_len) for r in got.collect()} == {("ltr5", 90)} and got.count() == n and used and not sizes.value


def test_empty(make_records):
    assert spans.shared_spans(make_records([])).collect() == []
