import random

import numpy as np
import pytest

from retromill.functions import edits
from retromill.functions.edits import edit_distances


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("alone", [True, False])
@pytest.mark.parametrize("share", [0.05, 0.3, 2.0])
def test_against_the_plain_table(share, alone, monkeypatch):
    if alone:  # every pair by itself
        monkeypatch.setattr(edits, "table", lambda raw, sa, la, sb, lb, most: [edits._alone(raw[a : a + n], raw[b : b + m]) for a, n, b, m in zip(sa, la, sb, lb)])
    rng = random.Random(4)
    pairs = []
    for n in (1, 2, 63, 64, 65, 128, 200):
        for _ in range(12):
            a = "".join(rng.choice("ACGTN") for _ in range(max(0, n + rng.randint(-2, 2))))
            b = "".join(rng.choice(["", x, x, x, x, "G", "TT"]) for x in a) if rng.random() < 0.8 else "".join(rng.choice("ACGT") for _ in range(n))
            pairs.append((a, b))
    pairs += [("", ""), ("A", ""), ("", "C")]
    text = "".join(a + b for a, b in pairs)
    la, lb = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    sa = np.append(0, np.cumsum(la + lb)[:-1])
    most = (np.maximum(la, lb) * share).astype(np.int64)
    got = edit_distances(np.frombuffer(text.encode(), np.uint8), sa, la, sa + la, lb, most)
    want = [plain(a, b) if a and b else -1 for a, b in pairs]
    assert got.tolist() == [d if d <= m else -1 for d, m in zip(want, most)]


def test_no_pairs():
    none = np.zeros(0, np.int64)
    assert len(edit_distances(np.zeros(0, np.uint8), none, none, none, none, none)) == 0
