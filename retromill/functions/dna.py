"""Sequence expressions, and numpy kernels over the Arrow buffers of whole batches of sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CODES = np.full(256, 4, np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _c in _pair:
        CODES[ord(_c)] = _i


def reverse_complement(s: Column) -> Column:
    """Reverse complement; letters other than ACGTacgt are kept. Null gives null."""
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def reverse_complement_iupac(s: Column) -> Column:
    """Reverse complement that also exchanges the ambiguity codes; null gives null."""
    return F.reverse(F.translate(s, "ACGTacgtRrYyKkMmBbVvDdHh", "TGCAtgcaYyRrMmKkVvBbHhDd"))


def canonical_word(s: Column) -> Column:
    """The smaller of a word and its reverse complement."""
    return F.least(s, reverse_complement(s))


def homopolymer_compress(s: Column) -> Column:
    """Each run of one letter becomes a single letter."""
    return F.regexp_replace(s, r"(.)\1+", "$1")


def homopolymer_lengths(s: Column) -> Column:
    """The length of each run of one letter, in order: what :func:`homopolymer_compress` takes away."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"((.)\2*)"), F.lit(1)), lambda run: F.length(run))


def homopolymer_expand(s: Column, lengths: Column) -> Column:
    """The sequence that was compressed to ``s`` with these ``lengths`` of its runs. Null if one is null."""
    return F.array_join(F.zip_with(F.split(s, ""), lengths, lambda x, n: F.repeat(x, n)), "")


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes 0-3 (4 for other letters) of all strings of a column, end to end, and the
    offsets of each; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return CODES[raw], offsets - offsets[0]


def pieces(codes: np.ndarray, offsets: np.ndarray, overlap: int, most: int = 1 << 22):
    """Cut a batch into runs of about ``most`` letters: (codes, offsets, index of the string of each
    piece, position in it of its first letter). A string longer than that is cut with ``overlap``
    letters in common, so that each window of ``overlap`` + 1 letters is in exactly one piece."""
    lens = np.diff(offsets)
    if len(codes) <= most:
        yield codes, offsets, np.arange(len(lens)), np.zeros(len(lens), np.int64)
        return
    at = 0
    while at < len(lens):
        if lens[at] > most:
            for begin in range(0, int(lens[at]) - overlap, most):
                part = codes[offsets[at] + begin : min(offsets[at] + begin + most + overlap, offsets[at + 1])]
                yield part, np.array([0, len(part)]), np.array([at]), np.array([begin])
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        longer = np.flatnonzero(lens[at:to] > most)
        to = at + int(longer[0]) if len(longer) else to
        yield codes[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], np.arange(at, to), np.zeros(to - at, np.int64)
        at = to


def valid_windows(codes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """For each position whether the window of ``size`` letters from it lies in one string and holds
    only A, C, G and T; one entry for each position at which a window fits the buffer."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    bad = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(codes > 3, out=bad[1:])
    ok = bad[size:] == bad[:-size]
    inner = offsets[1:-1]
    if len(inner) and size > 1:
        cross = (inner[:, None] - np.arange(1, size)).ravel()
        ok[cross[(cross >= 0) & (cross < n)]] = False
    return ok


def word_codes(codes: np.ndarray, k: int, dtype=np.uint64) -> np.ndarray:
    """The word of ``k`` letters at each position as a number in base 4, by doubling."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype)
    power, size = (codes & 3).astype(dtype), 1
    out, done, rest = None, 0, k
    while True:
        if rest & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else (out << dtype(2 * size)) | part
            done += size
        rest >>= 1
        if not rest:
            return out
        m = len(power) - size
        power = (power[:m] << dtype(2 * size)) | power[size:]
        size *= 2


def canonical_codes(codes: np.ndarray, k: int, dtype=np.uint32) -> np.ndarray:
    """The smaller code of each word and its reverse complement."""
    forward = word_codes(codes, k, dtype)
    flipped = word_codes((3 - (codes & 3))[::-1].astype(np.uint8), k, dtype)[::-1]
    return np.minimum(forward, flipped)


def word_texts(words: np.ndarray, k: int) -> pa.Array:
    """Words of ``k`` bases as strings, from their numbers."""
    letters = np.frombuffer(b"ACGT", np.uint8)[words[:, None] >> (2 * np.arange(k - 1, -1, -1)) & 3]
    return pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer((np.arange(len(words) + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters))])


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, one to one."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_of_position(offsets: np.ndarray, n: int) -> np.ndarray:
    """The index of the string that each of the first ``n`` positions lies in."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))[:n]
