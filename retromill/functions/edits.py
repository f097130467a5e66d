"""Edit distances of many pairs at once: each number of an array belongs to another pair, each of its bits to a row of
that pair's table (the bit-vector method of Myers, with blocks as Hyyrö describes them)."""

from __future__ import annotations

import numpy as np

#: numbers that an array operation has at most
WIDE = 1 << 12
ONE, TOP = np.uint64(1), np.uint64(63)


def _spread(raw: np.ndarray, start: np.ndarray, size: np.ndarray, wide: int, pad: int) -> np.ndarray:
    """The stretches of ``raw`` as rows of ``wide`` letters."""
    at = np.arange(wide)
    return np.where(at < size[:, None], raw[np.minimum(start[:, None] + at, max(len(raw) - 1, 0))], pad).astype(np.uint8)


def _chunks(la: np.ndarray, lb: np.ndarray, todo: np.ndarray, cells: int):
    """Pairs of like lengths together, so many that their tables have about ``cells`` numbers in a column."""
    blocks = -(-la[todo] // 64)
    todo = todo[np.lexsort((-lb[todo], blocks))]
    at = 0
    while at < len(todo):
        most = -(-int(la[todo[at]]) // 64)
        n = max(1, min(WIDE, cells // max(1, most + most // 4)))
        near = np.searchsorted(-(-la[todo] // 64), most + most // 4, "right")
        to = max(at + 1, min(at + n, int(near)))
        chunk = todo[at:to]
        yield chunk[np.argsort(-lb[chunk], kind="stable")]
        at = to


def coded(raw: np.ndarray) -> np.ndarray:
    """The letters as small numbers, one for each that occurs."""
    letters = np.flatnonzero(np.bincount(raw, minlength=256))
    code = np.zeros(256, np.uint8)
    code[letters] = np.arange(len(letters))
    return code[raw]


def table(raw: np.ndarray, sa: np.ndarray, la: np.ndarray, sb: np.ndarray, lb: np.ndarray, most: int, keep: list | None = None) -> np.ndarray:
    """Distances of pairs in the order of falling ``lb``, of :func:`coded` letters, right where they are at most ``most``. With ``keep`` each column
    adds its (free diagonal steps, rows that are one above the row before)."""
    n, blocks, cols = len(la), -(-int(la.max()) // 64), int(lb.max())
    a, b = _spread(raw, sa, la, blocks * 64, 255), np.ascontiguousarray(_spread(raw, sb, lb, cols, 0).T).astype(np.int64)
    equal = np.stack([np.packbits(a == s, axis=1, bitorder="little").view(np.uint64).T for s in range(int(b.max()) + 1)]).reshape(-1)
    pv, mv = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    active = np.searchsorted(-lb, -np.arange(cols), "left")
    own = np.arange(n)
    for j in range(cols):
        k = int(active[j])
        at = b[j, :k] * (blocks * n) + own[:k]
        hp, hm = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        free = np.zeros((blocks, n), np.uint64) if keep is not None else None
        for w in range(min(blocks, (j + most) // 64 + 1)):
            eq, p, m = equal.take(at + w * n), pv[w, :k], mv[w, :k]
            xv = eq | m
            eq |= hm
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            if free is not None:
                free[w, :k] = xh | m
            hp, ph, hm, mh = ph >> TOP, ph << ONE | hp, mh >> TOP, mh << ONE | hm
            pv[w, :k] = mh | ~(xv | ph)
            mv[w, :k] = ph & xv
        if keep is not None:
            keep.append((free, pv.copy()))
    row = np.arange(blocks)[:, None] * 64
    full = np.clip(la[None, :] - row, 0, 64).astype(np.uint64)
    mask = np.where(full == 64, ~np.uint64(0), (ONE << np.minimum(full, TOP)) - ONE)
    return lb + (np.bitwise_count(pv & mask).astype(np.int64) - np.bitwise_count(mv & mask)).sum(axis=0)


def _alone(a: np.ndarray, b: np.ndarray) -> int:
    """The same for one pair, its column as one long number."""
    n, rows = len(a), {int(x): int.from_bytes(np.packbits(a == x, bitorder="little").tobytes(), "little") for x in np.unique(a)}
    ones, top = (1 << n) - 1, n - 1
    vp, vn, d = ones, 0, n
    for x in b.tolist():
        eq = rows.get(x, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hn = vp & d0
        hp = vn | (ones & ~(vp | d0))
        d += (hp >> top & 1) - (hn >> top & 1)
        hp = hp << 1 | 1
        vn = hp & d0 & ones
        vp = (hn << 1 | ~(hp | d0)) & ones
    return d


def edit_distances(raw: np.ndarray, sa: np.ndarray, la: np.ndarray, sb: np.ndarray, lb: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The unit-cost edit distance of each pair of stretches (start and length in ``raw``), -1 where it is above ``most`` or
    a side is empty."""
    out = np.full(len(la), -1, np.int64)
    todo = np.flatnonzero((la > 0) & (lb > 0) & (np.abs(la - lb) <= most))
    raw = coded(raw)
    for c in _chunks(la, lb, todo, 1 << 15):
        # an operation costs about as much as a thousand of its numbers, so a few pairs are faster one by one
        together = int(lb[c].max()) * -(-int(la[c].max()) // 64) * 20 * (1000 + len(c))
        if together < int(lb[c].sum()) * 15 * 1000:
            out[c] = table(raw, sa[c], la[c], sb[c], lb[c], int(most[c].max()))
        else:
            out[c] = [_alone(raw[a : a + n], raw[b : b + m]) for a, n, b, m in zip(sa[c].tolist(), la[c].tolist(), sb[c].tolist(), lb[c].tolist())]
    return np.where(out <= most, out, -1)
