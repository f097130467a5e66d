import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retromill.functions import dna
from retromill.operators.seeds import postings, repeat_diagonals


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_batches(kind):
    texts = ["ACGTNacgtA", None, "", "GATTACA", "AC"]
    column = pa.array(["xx", *texts], kind).slice(1)
    codes, off = dna.encode(column)
    for k in (1, 2, 3, 5, 7):
        ok = dna.valid_windows(codes, off, k)
        word = dna.word_codes(codes, k)
        who = dna.string_of_position(off, len(ok))
        got = [(int(who[i]), int(word[i])) for i in np.flatnonzero(ok)]
        want = [(t, int("".join(map(str, ("ACGT".index(c) for c in w))), 4)) for t, s in enumerate(texts) for i in range(len(s or "") - k + 1) if not set(w := s[i : i + k].upper()) - set("ACGT")]
        assert got == want
        flip = str.maketrans("0123", "3210")
        canonical = dna.canonical_codes(codes, k)
        assert [int(canonical[i]) for i in np.flatnonzero(ok)] == [min(w, int(np.base_repr(w, 4).zfill(k).translate(flip)[::-1], 4)) for _, w in want]


def test_long_strings_are_cut_with_all_windows():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 5, 1000, 3, 333, 64, 0)]
    codes, off = dna.encode(pa.array(texts))
    seen = []
    for part, o, of, begin in dna.pieces(codes, off, 9, 64):
        for i in np.flatnonzero(dna.valid_windows(part, o, 10)):
            s = int(np.searchsorted(o, i, "right") - 1)
            seen.append((int(of[s]), int(begin[s] + i - o[s])))
    assert sorted(seen) == [(t, i) for t, s in enumerate(texts) for i in range(len(s) - 9)]


def test_column_functions(spark):
    df = spark.createDataFrame([("AACCGGTTNn",), ("",), (None,), ("acgtRY",)], "s string")
    got = df.select(dna.reverse_complement(F.col("s")), dna.reverse_complement_iupac(F.col("s")), dna.homopolymer_compress(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("nNAACCGGTT", "nNAACCGGTT", "ACGTNn"), ("", "", ""), (None, None, None), ("YRacgt", "RYacgt", "acgtRY")]


def test_documented_numbers(spark):
    """Ten short sequences with the totals that the format's documents print cannot be shipped; the same
    statistics on one made by hand."""
    from retromill.operators import stats

    df = spark.createDataFrame([("aacgtn",), ("ACGT",), ("gg",), (None,)], "s string")
    assert tuple(stats.sequence_stats(df, "s").first()) == (3, 12, 4.0, 2, 6)
    assert {r.base: r.n for r in stats.base_composition(df, "s").collect()} == {"a": 3, "c": 2, "g": 4, "n": 1, "t": 2, "other": 0}
    assert stats.length_quantile(df, "s").first().n50 == 6
    none = df.where("false")
    assert tuple(stats.sequence_stats(none, "s").first()) == (0, 0, None, None, None) and stats.base_composition(none, "s").agg(F.sum("n")).first()[0] == 0


def test_positions_with_other_letters_are_spread(spark):
    df = spark.createDataFrame([(1, "ACGTTNACGTACG", "x"), (2, "ACGT", "x"), (3, "ACG", "x"), (4, None, "x")], "id long, seq string, word string")
    got = {(r.id, r.word, r.pos) for r in postings(df, "id", "seq", 4).collect()}
    want = set()
    for i, s in ((1, "ACGTTNACGTACG"), (2, "ACGT")):
        ws = [s[p : p + 4] for p in range(len(s) - 3) if "N" not in s[p : p + 4]]
        for p, w in enumerate(ws):
            c = min(w, w.translate(str.maketrans("ACGT", "TGCA"))[::-1])
            pos = (p * (len(s) - 4) + (len(ws) - 1) // 2) // (len(ws) - 1) if len(ws) > 1 else 0
            if not any(x == (i, c) for x in [(a, b) for a, b, _ in want]):
                want.add((i, c, pos))
    assert got == {(i, int("".join(str("ACGT".index(b)) for b in c), 4), p) for i, c, p in want}


def test_repeats_within_a_sequence(spark):
    rng = random.Random(4)
    ltr, inner = ("".join(rng.choice("ACGT") for _ in range(n)) for n in (120, 500))
    df = spark.createDataFrame([(1, ltr + inner + ltr), (2, inner), (3, "")], "id long, seq string")
    r = repeat_diagonals(df, "id", "seq").collect()
    assert [(x.id, x.diagonal, x.first_pos, x.last_pos) for x in r] == [(1, 620 // 64, 0, 108)]
    turned = df.sparkSession.createDataFrame([(1, ltr + inner + ltr.translate(str.maketrans("ACGT", "TGCA"))[::-1]), (2, ltr + inner + ltr)], "id long, seq string")
    r = repeat_diagonals(turned, "id", "seq", inverted=True, width=1).collect()
    assert [(x.id, x.diagonal, x.n_words) for x in r] == [(1, 740 - 12, 109)]
