"""Pairs of sequences that share words: seeding, orientation and anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retromill.functions.dna import canonical_codes, encode, pieces, valid_windows, word_codes, word_texts
from retromill.functions.groups import begins, numbers, whole_groups
from retromill.shared import spread

POSTING = "word int, id long, pos int, len int"
#: positions beyond this are all read as this one
LAST_POSITION = 65535


def _words(batch: pa.RecordBatch, column: str, k: int, among: np.ndarray | None = None):
    """The distinct words of each string of a column, in the order of (string, word): the string's index, the canonical
    word, its smallest position, and the length of each string. Only words whose bit is set in ``among``."""
    codes, offsets = encode(batch.column(column))
    lens = np.diff(offsets)
    found, cut = [], False
    for part, off, of, begin in pieces(codes, offsets, k - 1):
        ok = valid_windows(part, off, k)
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        word = canonical_codes(part, k)[at].astype(np.int64)
        s = np.searchsorted(off, at, "right") - 1
        first = np.searchsorted(s, np.arange(len(of)))
        n = np.diff(np.append(first, len(at)))[s]
        p = np.arange(len(at)) - first[s]
        pos = np.where(n > 1, (p * (np.minimum(lens[of[s]], off[s + 1] - off[s]) - k) + (n - 1) // 2) // np.maximum(n - 1, 1), 0) + begin[s]
        if among is not None:
            keep = (among[word >> 6] >> (word & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            word, s, pos = word[keep], s[keep], pos[keep]
        _, keep = np.unique(s.astype(np.int64) << 24 | word, return_index=True)
        cut |= bool(begin.any())
        found.append((of[s[keep]], word[keep], pos[keep]))
    if not found:
        return (*(np.zeros(0, np.int64),) * 3, lens)
    s, word, pos = (np.concatenate(x) for x in zip(*found))
    if cut:  # a string in several pieces may have a word in each
        _, keep = np.unique(s.astype(np.int64) << 24 | word, return_index=True)
        s, word, pos = s[keep], word[keep], pos[keep]
    return s, word, np.minimum(pos, LAST_POSITION), lens


def canonical_words(rows: DataFrame, id_: str, seq: str, k: int = 12) -> DataFrame:
    """``id_``, ``word``, ``pos``, ``n``: each distinct canonical word of each sequence with its smallest position and its
    number. Nothing is shuffled; null and short sequences have none."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 500):
            codes, offsets = encode(batch.column(seq))
            at = np.flatnonzero(valid_windows(codes, offsets, k))
            if not len(at):
                continue
            s = np.searchsorted(offsets, at, "right") - 1
            key, first, n = np.unique(s.astype(np.int64) << 24 | canonical_codes(codes, k)[at], return_index=True, return_counts=True)
            s = key >> 24
            yield pa.RecordBatch.from_arrays([batch.column(id_).take(pa.array(s)), word_texts(key & ((1 << 24) - 1), k), pa.array(at[first] - offsets[s]), pa.array(n)], [id_, "word", "pos", "n"])

    some = rows.select(id_, seq).where(F.length(seq) >= k)
    return some.mapInArrow(over, StructType([some.schema[id_], *StructType.fromDDL("word string, pos long, n long").fields]))


def _read(rows: DataFrame, id_: str, seq: str, k: int) -> DataFrame:
    if not 4 <= k <= 12:
        raise ValueError("k must be 4 to 12")
    return rows.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(seq), F.lit("")).alias("seq")).where("id is not null")


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, n):
            yield whole.slice(at, n)


def postings(rows: DataFrame, id_: str, seq: str, k: int = 12, among: np.ndarray | None = None) -> DataFrame:
    """``word`` (the canonical word as a number), ``id``, ``pos`` (its smallest position), ``len``: one row
    for each distinct word of each sequence, of those in ``among`` (:func:`usable_words`) if it is given. Positions are
    spread evenly over the words that a
    sequence has, so they are exact if all its letters are A, C, G or T. Null and short sequences
    have none."""
    held = rows.sparkSession.sparkContext.broadcast(among)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2000):
            ids = numbers(batch, "id")
            s, word, pos, lens = _words(batch, "seq", k, held.value)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(ids[s]), pa.array(pos.astype(np.int32)), pa.array(lens[s].astype(np.int32))], ["word", "id", "pos", "len"])

    return _read(rows, id_, seq, k).mapInArrow(over, POSTING)


def word_counts(rows: DataFrame, id_: str, seq: str, k: int = 12) -> DataFrame:
    """``word``, ``n``: how many sequences have each word. Tasks count before the shuffle, one number for each of the at
    most 4^k words, so a word that all sequences have is no hot key."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**k, np.int32)
        for batch in _slices(batches, 2000):
            word, n = np.unique(_words(batch, "seq", k)[1], return_counts=True)
            total[word] += n.astype(np.int32)
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 16):
            own = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own].astype(np.int64))], ["word", "n"])

    return _read(rows, id_, seq, k).mapInArrow(over, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))


def usable_words(counts: DataFrame, max_bucket: int, k: int = 12) -> np.ndarray:
    """Bits of the words that 2 to ``max_bucket`` sequences have: 4^k bits, so 2 MB at most however many sequences
    there are."""
    some = counts.where(F.col("n").between(2, max_bucket)).groupBy(F.shiftright("word", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, word & 63))").alias("bits")).toArrow()
    out = np.zeros(max(1, 4**k // 64), np.uint64)
    out[some.column("at").to_numpy()] = some.column("bits").to_numpy().astype(np.uint64)
    return out


def bucket_sizes(counts: DataFrame) -> DataFrame:
    """``size``, ``n_words``: how many words so many sequences have, from :func:`word_counts`."""
    return counts.groupBy(F.col("n").alias("size")).agg(F.count(F.lit(1)).alias("n_words"))


def bucket_histogram(counts: DataFrame, max_bucket: int) -> DataFrame:
    """``size``, ``n_words``: how many words 2 to ``max_bucket`` sequences share, and with null ``size`` how many more do."""
    some = bucket_sizes(counts).where("size >= 2")
    return some.groupBy(F.when(F.col("size") <= max_bucket, F.col("size")).alias("size")).agg(F.sum("n_words").alias("n_words"))


def shared_words(rows: DataFrame, id_: str, seq: str, max_bucket: int, max_ratio: float | None = None, elements: int | None = None, k: int = 12) -> DataFrame:
    """``i`` < ``j``, ``pi``, ``pj``, ``word``: each word that two sequences share. A word that more than
    ``max_bucket`` sequences have is no seed and is left out whole, which also bounds the pairs of a
    word. Words are counted first, and those of one sequence and of too many never leave the tasks that read the
    sequences. With ``elements``, identifiers that are equal modulo it are one element and are not paired;
    ``max_ratio`` bounds the ratio of the lengths."""
    among = usable_words(word_counts(rows, id_, seq, k), max_bucket, k)
    return _meetings(postings(rows, id_, seq, k, among), max_ratio, elements).select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), F.col("pos_a").alias("pi"), F.col("pos_b").alias("pj"), "word")


def _meetings(post: DataFrame, max_ratio: float | None, elements: int | None) -> DataFrame:
    """Two postings of one word, the smaller identifier first."""
    p = spread(post, "word")
    a, b = (p.select("word", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "pos", "len"))) for x in "ab")
    pairs = a.join(b, "word").where("id_a < id_b")
    if elements:
        pairs = pairs.where((F.col("id_a") % elements) != (F.col("id_b") % elements))
    if max_ratio:
        pairs = pairs.where(F.greatest("len_a", "len_b") <= F.least("len_a", "len_b") * F.lit(max_ratio))
    return pairs


def pair_counts(rows: DataFrame, among: np.ndarray, max_ratio: float | None = None, elements: int | None = None, k: int = 12) -> DataFrame:
    """``i`` < ``j``, ``n``: how many words of ``among`` two sequences of ``rows`` (``id``, ``seq``) share, under the
    same conditions as :func:`shared_words`. Pairs are counted before they are shuffled."""
    met = _meetings(postings(rows, "id", "seq", k, among), max_ratio, elements)
    return met.groupBy(F.col("id_a").alias("i"), F.col("id_b").alias("j")).agg(F.count(F.lit(1)).alias("n"))


def _anchor(begin: np.ndarray, pi: np.ndarray, pj: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For groups of shared words, which begin at ``begin``: their number, whether the strands are opposite, and the index
    of the anchor."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(pi)))
    g = np.repeat(np.arange(len(begin)), n)
    si, sj = np.add.reduceat(pi, begin), np.add.reduceat(pj, begin)
    u, v = pi - (si // n)[g], pj - (sj // n)[g]  # the same covariance in smaller numbers
    rc = n * np.add.reduceat(u * v, begin) - np.add.reduceat(u, begin) * np.add.reduceat(v, begin) < 0
    off = np.abs(n[g] * np.where(rc[g], pi + pj, pi - pj) - np.where(rc, si + sj, si - sj)[g])
    near = np.flatnonzero(off == np.minimum.reduceat(off, begin)[g])
    near = near[np.lexsort((word[near], pi[near], g[near]))]
    return n, rc, near[begins(g[near])]


ANCHOR = "n_shared long, is_rc boolean, pi int, pj int"


def anchored_pairs(events: DataFrame, min_shared: int = 3) -> DataFrame:
    """``i``, ``j``, ``n_shared``, ``is_rc``, ``pi``, ``pj`` for pairs with at least ``min_shared`` shared words.

    Two sequences lie on opposite strands if the positions of their shared words are negatively
    related (computed in integers; none is forward). The anchor is the shared word nearest to the
    mean diagonal (antidiagonal if opposite), on a tie the one with the smaller position in the
    first, then the smaller word. The words of one pair, fewer than the bases of its sequences, meet in
    one task, sorted by pair."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "i", "j"):
            i, j, pi, pj, word = (numbers(t, c) for c in ("i", "j", "pi", "pj", "word"))
            begin = begins(i, j)
            n, rc, at = _anchor(begin, pi, pj, word)
            k = n >= min_shared
            yield pa.RecordBatch.from_arrays([pa.array(x[k]) for x in (i[begin], j[begin], n, rc, pi[at].astype(np.int32), pj[at].astype(np.int32))], ["i", "j", "n_shared", "is_rc", "pi", "pj"])

    return spread(events, "i", "j").sortWithinPartitions("i", "j").mapInArrow(over, f"i long, j long, {ANCHOR}")


def anchored(pairs: DataFrame, a: str, b: str, among: np.ndarray, min_shared: int = 3, k: int = 12) -> DataFrame:
    """``pairs`` (``i``, ``j``) with ``n_shared``, ``is_rc``, ``pi``, ``pj`` as :func:`anchored_pairs` has them, for given pairs with both
    sequences in columns ``a`` and ``b``: their words are compared directly, so no word is shuffled. Pairs that share
    fewer words of ``among`` have no row."""
    held = pairs.sparkSession.sparkContext.broadcast(among)

    def side(t: pa.RecordBatch, id_: str, column: str) -> tuple[np.ndarray, np.ndarray]:
        """The words of each row's sequence with the row before them; a sequence of several rows is read once."""
        _, first, which = np.unique(numbers(t, id_), return_index=True, return_inverse=True)
        s, word, pos, lens = _words(t.select([column]).take(pa.array(first)), column, k, held.value)
        begin = np.searchsorted(s, np.arange(len(lens) + 1))
        size = np.diff(begin)[which]
        at = np.repeat(begin[which] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(which)), size) << 24 | word[at], pos[at]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _slices(batches, 1000):
            (x, px), (y, py) = side(t, "i", a), side(t, "j", b)
            at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
            same = y[at] == x if len(y) else np.zeros(len(x), bool)
            x, pi, pj = x[same], px[same], py[at[same]] if len(y) else px[same]
            begin = begins(x >> 24)
            n, rc, best = _anchor(begin, pi, pj, x & ((1 << 24) - 1))
            keep = n >= min_shared
            row, best = (x[begin] >> 24)[keep], best[keep]
            own = [c.take(pa.array(row)) for c in t.columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n[keep]), pa.array(rc[keep]), pa.array(pi[best].astype(np.int32)), pa.array(pj[best].astype(np.int32))], [*t.schema.names, "n_shared", "is_rc", "pi", "pj"])

    return pairs.mapInArrow(over, StructType([*pairs.schema.fields, *StructType.fromDDL(ANCHOR).fields]))


#: sequences of up to so many bases are searched within one task
WHOLE = 1 << 22


def _partners(group: np.ndarray, at: np.ndarray, forward: np.ndarray, source: np.ndarray, least: int, most: int, inverted: bool) -> tuple[np.ndarray, np.ndarray]:
    """For occurrences sorted by ``group`` and ``at``: the indices of those in ``source`` and of their next one of the group,
    on the other strand if ``inverted``, at a distance of ``least`` to ``most``."""
    place = group.astype(np.int64) << 33 | at
    a, b = [], []
    for strand in (True, False) if inverted else (None,):
        mine = np.flatnonzero(source if strand is None else source & (forward == strand))
        other = np.arange(len(place)) if strand is None else np.flatnonzero(forward != strand)
        if not len(mine) or not len(other):
            continue
        k = np.searchsorted(place[other], place[mine] + least)
        mine, k = mine[k < len(other)], k[k < len(other)]
        near = place[other[k]] - place[mine] <= most
        a.append(mine[near])
        b.append(other[k[near]])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def repeat_diagonals(rows: DataFrame, id_: str, seq: str, k: int = 12, least: int = 200, most: int = 30_000, width: int = 64, hits: int = 10, inverted: bool = False, over: bool = False) -> DataFrame:
    """Two similar copies on one sequence, as of an element's two long repeats: ``id``, ``diagonal``
    (the distance of the copies, in bins of ``width``), ``n_words``, ``first_pos``, ``last_pos`` (of the
    first copy) for bins with at least ``hits`` words that recur at a distance of ``least`` to ``most``.
    With ``inverted`` the second copy is read on the other strand, and ``diagonal`` is the sum of both
    positions. A word is paired with its next occurrence on the sequence only, so repeats of many units
    give rows in proportion to the sequence; with ``over`` it is its next occurrence at ``least`` or more, so one that recurs nearby too
    is not passed over. With a small ``least`` it shows tandem arrays. The words of a sequence longer
    than ``WHOLE``, such as a chromosome, are met by a shuffle, those of others in the task that reads them."""

    def paired(s: np.ndarray, word: np.ndarray, at: np.ndarray, forward: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(s.astype(np.int64) << 24 | word, kind="stable")
        if over:
            group = np.zeros(len(order), np.int64)
            group[begins(s[order], word[order])[1:]] = 1
            a, b = _partners(np.cumsum(group), at[order], forward[order], np.ones(len(order), bool), least, most, inverted)
            return order[a], order[b]
        a, b = order[:-1], order[1:]
        far = at[b] - at[a]
        hit = (s[a] == s[b]) & (word[a] == word[b]) & (far >= least) & (far <= most)
        if inverted:
            hit &= forward[a] != forward[b]
        return a[hit], b[hit]

    def read(batch: pa.RecordBatch):
        codes, offsets = encode(batch.column("seq"))
        for part, off, of, begin in pieces(codes, offsets, k - 1, WHOLE):
            at = np.flatnonzero(valid_windows(part, off, k))
            if len(at):
                s = np.searchsorted(off, at, "right") - 1
                plain = word_codes(part, k)[at].astype(np.int64)
                word = canonical_codes(part, k)[at].astype(np.int64) if inverted else plain
                yield of[s], word, at - off[s] + begin[s], plain == word

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2000):
            ids = numbers(batch, "id")
            for s, word, at, forward in read(batch):
                a, b = paired(s, word, at, forward)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s[a]]), pa.array((at[b] + at[a] if inverted else at[b] - at[a]) // width), pa.array(at[a])], ["id", "diagonal", "pos"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            for s, word, at, forward in read(batch):
                yield pa.RecordBatch.from_arrays([pa.array(numbers(batch, "id")[s]), pa.array(word), pa.array(at), pa.array(forward)], ["id", "word", "at", "forward"])

    every = rows.select(F.col(id_).cast("long").alias("id"), F.coalesce(F.col(seq), F.lit("")).alias("seq"))
    found = every.where(F.length("seq") <= WHOLE).mapInArrow(near, "id long, diagonal long, pos long")
    long_ = every.where(F.length("seq") > WHOLE).mapInArrow(words, "id long, word long, at long, forward boolean")
    if over:
        span = most + 1
        own = F.floor(F.col("at") / span)
        bins = long_.withColumn("own", own).withColumn("bin", F.explode(F.array("own", F.col("own") - 1)))  # a partner is in the same bin or the next
        bins = bins.select("id", "word", "bin", "at", "forward", (F.col("bin") == F.col("own")).alias("source"))

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_groups(batches, "id", "word", "bin"):
                keys = [numbers(t, c) for c in ("id", "word", "bin")]
                group = np.zeros(t.num_rows, np.int64)
                group[begins(*keys)[1:]] = 1
                at, forward, source = numbers(t, "at"), numbers(t, "forward") > 0, numbers(t, "source") > 0
                a, b = _partners(np.cumsum(group), at, forward, source, least, most, inverted)
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][a]), pa.array((at[b] + at[a] if inverted else at[b] - at[a]) // width), pa.array(at[a])], ["id", "diagonal", "pos"])

        far = spread(bins, "id", "word", "bin").sortWithinPartitions("id", "word", "bin", "at").mapInArrow(binned, "id long, diagonal long, pos long")
        bins = found.unionByName(far).groupBy("id", "diagonal").agg(F.count(F.lit(1)).alias("n_words"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
        return bins.where(F.col("n_words") >= hits)
    w = Window.partitionBy("id", "word").orderBy("at")
    long_ = long_.select("id", F.col("at").alias("pos"), F.lead("at").over(w).alias("next"), (F.col("forward") != F.lead("forward").over(w)).alias("turned"))
    long_ = long_.where(F.col("next") - F.col("pos") >= least).where(F.col("next") - F.col("pos") <= most).where(F.col("turned") if inverted else F.lit(True))
    found = found.unionByName(long_.select("id", F.floor((F.col("next") + (F.col("pos") if inverted else -F.col("pos"))) / width).alias("diagonal"), "pos"))
    bins = found.groupBy("id", "diagonal").agg(F.count(F.lit(1)).alias("n_words"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    return bins.where(F.col("n_words") >= hits)
