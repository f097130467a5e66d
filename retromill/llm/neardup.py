"""Near-duplicate records with small edits (problem 3)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retromill.functions.dna import canonical_codes, encode, valid_windows
from retromill.functions.groups import begins, numbers, whole_groups
from retromill.shared import join_hot_keys, materialize
from retromill.sources.records import distinct_records

FIELDS = ("ltr5", "internal", "ltr3")
K = 12
#: bits of a fingerprint: one for each word of 12 bases, so no two words share a bit
BITS = 24
#: beyond all bits: no word
NONE = np.uint32(1 << BITS)
SEGMENTS = 1024
PROBES = 32
#: sets of up to so many words for each probe are probed from every set bit
DENSE = 8
#: records of one cell and size class that meet in one block; two blocks meet in one task
BLOCK = 256
#: copies of one fingerprint that are expanded in one group
COPIES = 1000

_BYTE = np.arange(256, dtype=np.uint8)
#: the four bases of each byte
FOUR = np.stack((_BYTE >> 6, _BYTE >> 4 & 3, _BYTE >> 2 & 3, _BYTE & 3), 1)

PRINT = "rec long, name string, n int, digest binary, keys array<long>, pops binary, packed binary"


def _bit(word: np.ndarray) -> np.ndarray:
    """The bit of each word: a one-to-one mixing of 24 bits."""
    mask = np.uint32((1 << BITS) - 1)
    x = word.astype(np.uint32)
    for factor in (0x9E3779, 0x85EBCB):
        x = (x * np.uint32(factor)) & mask
        x ^= x >> np.uint32(13)
    return x


def _set_bits(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit of the word at each position, and which positions have one."""
    return _bit(canonical_codes(codes, K)), valid_windows(codes, offsets, K)


def _keys(bits: np.ndarray, probes: int | None) -> np.ndarray:
    """Cells of a sorted fingerprint: the two set bits that follow each probe, the end joined to the
    beginning; without ``probes`` every set bit."""
    n = len(bits)
    alone = bits.astype(np.int64) << BITS | bits
    if probes is None:
        return alone
    if n > DENSE * probes:
        i = np.searchsorted(bits, (np.arange(probes) << BITS) // probes) % n
    else:
        i = np.arange(n)
    keys = bits[i].astype(np.int64) << BITS | bits[(i + 1) % n]
    return np.unique(np.append(keys, alone) if n <= probes else keys)


def _counts(bits: np.ndarray) -> bytes:
    """Set bits in each segment, 15 at most, two segments to a byte."""
    n = np.minimum(np.bincount(bits >> np.uint32(BITS - 10), minlength=SEGMENTS), 15).astype(np.uint8)
    return (n[::2] << 4 | n[1::2]).tobytes()


def _pack_runs(codes: np.ndarray, cuts: np.ndarray) -> bytes:
    """The runs of A, C, G and T of at least ``K`` bases, two bits a base, after their lengths."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes < 4).astype(np.int8), [0]))))
    if len(cuts):
        inside = cuts[(codes[np.minimum(cuts, len(codes) - 1)] < 4) & (codes[cuts - 1] < 4)]
        edge = np.sort(np.concatenate((edge, inside, inside)))
    start, length = edge[::2], edge[1::2] - edge[::2]
    keep = length >= K
    start, length = start[keep], length[keep]
    total = int(length.sum())
    at = np.repeat(start - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(total) if total else np.zeros(0, np.int64)
    flat = np.zeros(-(-total // 4) * 4, np.uint8)
    flat[:total] = codes[at]
    four = flat.reshape(-1, 4)
    packed = (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8)
    return np.append(len(length), length).astype(np.int32).tobytes() + packed.tobytes()


def _unpack_runs(column: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all runs of all rows, the offsets of the runs, and the offset of each row's codes. The
    bases that fill a last byte are a run too short for a word."""
    length, rows, raw = [], np.zeros(len(column) + 1, np.int64), []
    for i, packed in enumerate(column):
        n = int.from_bytes(packed[:4], "little")
        own = np.frombuffer(packed, np.int32, n, 4)
        begin = 4 * (n + 1)
        raw.append(packed[begin:])
        length += (own, [4 * (len(packed) - begin) - int(own.sum())])
        rows[i + 1] = rows[i] + 4 * (len(packed) - begin)
    codes = FOUR[np.frombuffer(b"".join(raw), np.uint8)].ravel()
    return codes, np.append(0, np.cumsum(np.concatenate(length))) if length else np.zeros(1, np.int64), rows


def _fingerprints(batches: Iterator[pa.RecordBatch], probes: int | None) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            fields = [encode(batch.column(f)) for f in FIELDS]
            # the words of all records at once, so that a record costs a few calls only
            bits = [np.where(ok, x, NONE) for x, ok in (_set_bits(c, o) for c, o in fields)]
            out: dict[str, list] = {c: [] for c in ("n", "digest", "keys", "pops", "packed")}
            for i in range(batch.num_rows):
                own = np.sort(np.concatenate([x[o[i] : max(o[i], o[i + 1] - K + 1)] for x, (_, o) in zip(bits, fields)]))
                own = own[: np.searchsorted(own, NONE)]
                own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
                out["n"].append(len(own))
                out["digest"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                out["keys"].append(_keys(own, probes) if len(own) else np.zeros(0, np.int64))
                out["pops"].append(_counts(own))
                parts = [c[o[i] : o[i + 1]] for c, o in fields]
                codes, cuts = np.concatenate(parts), np.unique(np.cumsum([len(p) for p in parts[:-1]]))
                out["packed"].append(_pack_runs(codes, cuts[(cuts > 0) & (cuts < len(codes))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rec"), batch.column("name"), pa.array(out["n"], pa.int32()), pa.array(out["digest"], pa.binary()), pa.array(out["keys"], pa.list_(pa.int64())), pa.array(out["pops"], pa.binary()), pa.array(out["packed"], pa.binary())],
                ["rec", "name", "n", "digest", "keys", "pops", "packed"],
            )


def _pairs(share: float):
    """Rows sorted by cell: the pairs of a cell whose sizes allow the similarity; the members of a
    cell that is too large for that come out alone, with -1 beside them."""

    def out(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(key)], ["a", "b", "key"])

    def of(key: np.ndarray, rec: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        for m in np.unique(size[size > 1]):
            first = begin[size == m]
            if m > BLOCK:
                at = (first[:, None] + np.arange(m)).ravel()
                yield out(rec[at], np.full(len(at), -1), key[at])
                continue
            i, j = np.triu_indices(m, 1)
            step = max(1, 200_000 // len(i))
            for f in range(0, len(first), step):
                x, y = (first[f : f + step, None] + i).ravel(), (first[f : f + step, None] + j).ravel()
                fit = np.minimum(n[x], n[y]) >= share * np.maximum(n[x], n[y])
                x, y = x[fit], y[fit]
                a, b = np.minimum(rec[x], rec[y]), np.maximum(rec[x], rec[y])
                yield out(a, b, np.zeros(len(a), np.int64))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        large = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(np.concatenate((h, batch.column(c).to_numpy(zero_copy_only=False))) for h, c in zip(held, ("key", "rec", "n")))
            key = cols[0]
            cut = int(np.searchsorted(key, key[-1], "left"))
            if large is not None:  # the rest of a large cell is passed on as it comes
                stop = int(np.searchsorted(key, large, "right"))
                if stop:
                    yield out(cols[1][:stop], np.full(stop, -1), key[:stop])
                cols = tuple(c[stop:] for c in cols)
                large, cut = (large, 0) if stop == len(key) else (None, cut - stop)
            if cut > 0:
                yield from of(*(c[:cut] for c in cols))
                cols = tuple(c[cut:] for c in cols)
            if len(cols[0]) > BLOCK:
                large = int(cols[0][-1])
                yield out(cols[1], np.full(len(cols[1]), -1), cols[0])
                cols = tuple(c[:0] for c in cols)
            held = cols
        if len(held[0]):
            yield from of(*held)

    return over


def _blocks(share: float):
    """Rows sorted by (cell, block, other block): the pairs of the two blocks whose sizes allow the similarity."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key", "lo", "hi"):
            key, lo, hi, own, rec, n = (numbers(t, c) for c in ("key", "lo", "hi", "own", "rec", "n"))
            begin = begins(key, lo, hi)
            for f, e in zip(begin, np.append(begin[1:], len(key))):
                left, right = f + np.flatnonzero(own[f:e] == lo[f]), f + np.flatnonzero(own[f:e] == hi[f])
                x, y = np.repeat(left, len(right)), np.tile(right, len(left))
                fit = np.minimum(n[x], n[y]) >= share * np.maximum(n[x], n[y])
                fit &= (rec[x] < rec[y]) if lo[f] == hi[f] else (rec[x] != rec[y])
                x, y = rec[x[fit]], rec[y[fit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return over


def _large_cells(cells: DataFrame, share: float) -> DataFrame:
    """Pairs of the cells (``key``, ``rec``, ``n``) that hold too many records for one group, by range of size: the
    records of a cell fall in size classes, of which only the same and neighbouring ones can be alike, and each class
    into blocks by hash. Two blocks meet in one task, whose size does not depend on the cell's."""
    cells, facts = materialize(cells.withColumn("cls", F.floor(F.log(F.col("n")) / math.log(1 / share)).cast("long")), F.count(F.lit(1)).alias("n"))
    parts = cells.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("size")).withColumn("parts", F.ceil(F.col("size") / BLOCK))
    near = lambda d, c: parts.select("key", (F.col("cls") + d).alias("cls"), F.col("parts").alias(c))
    side = parts.join(near(-1, "above"), ["key", "cls"], "left").join(near(1, "below"), ["key", "cls"], "left")
    side, _ = materialize(side.select(F.struct("key", "cls").alias("cell"), "size", "parts", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce("below", F.lit(0)).alias("below")))
    placed = join_hot_keys(cells.select(F.struct("key", "cls").alias("cell"), "rec", "n"), side, "cell", "size", facts["n"])
    block = lambda cls, part: cls * (1 << 32) + part
    cls, own = F.col("cell.cls"), block(F.col("cell.cls"), F.pmod(F.xxhash64("rec"), "parts"))
    every = lambda c, d: F.transform(F.sequence(F.lit(0).cast("long"), F.col(c) - 1), lambda i: block(cls + d, i))
    none = F.array().cast("array<bigint>")
    others = F.concat(every("parts", 0), F.when(F.col("above") > 0, every("above", 1)).otherwise(none), F.when(F.col("below") > 0, every("below", -1)).otherwise(none))
    met = placed.select(F.col("cell.key").alias("key"), "rec", "n", own.alias("own"), F.explode(others).alias("other"))
    met = met.select("key", "rec", "n", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    return met.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_blocks(share), "a long, b long")


def _bounded(share: float):
    """The pairs for which the Manhattan distance of their bit counts, a lower bound of the number of differing
    bits, allows the share."""

    def counts(column: pa.Array) -> np.ndarray:
        flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SEGMENTS // 2)
        return np.concatenate((flat >> 4, flat & 15), axis=1).view(np.int8)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                t = whole.slice(at, 2000)
                far = np.abs(counts(t.column("qa")) - counts(t.column("qb"))).sum(axis=1, dtype=np.int64)
                keep = pa.array(far * (1 + share) <= (1 - share) * (numbers(t, "na") + numbers(t, "nb")) + 1e-6)
                yield pa.RecordBatch.from_arrays([t.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return over


def _verify(share: float):
    """Exact similarity of candidate pairs, rows with the same ``b`` together: the words of ``b`` get numbers, and of the
    words of all its partners each number counts once for each partner."""

    def words(column: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, runs, rows = _unpack_runs(column)
        return canonical_codes(codes, K), valid_windows(codes, runs, K), rows

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.zeros(1 << BITS, np.int32)
        marked, last = np.zeros(0, np.uint32), None
        for whole in batches:
            for at in range(0, whole.num_rows, 2500):
                batch = whole.slice(at, 2500)
                a, b, na, nb = (numbers(batch, c) for c in ("a", "b", "na", "nb"))
                # a record that has several partners here is read once
                _, first, which = np.unique(a, return_index=True, return_inverse=True)
                code, ok, rows = words(batch.column("pa").take(pa.array(first)).to_pylist())
                rows = np.minimum(rows, len(code))
                begin, packed = begins(b), batch.column("pb")
                common = np.zeros(batch.num_rows, np.int64)
                for f, e in zip(begin, np.append(begin[1:], len(b))):
                    if b[f] != last:
                        slot[marked] = 0
                        found, fine, _ = words([packed[int(f)].as_py()])
                        marked, last = np.unique(found[fine[: len(found)]]), b[f]
                        slot[marked] = np.arange(1, len(marked) + 1)
                    wide = len(marked) + 1
                    step = max(1, 4_000_000 // wide)
                    for lo in range(f, e, step):
                        hi = min(e, lo + step)
                        own = [slice(rows[w], rows[w + 1]) for w in which[lo:hi]]
                        hits = [slot[code[x]] * ok[x] + i * wide for i, x in enumerate(own)]
                        seen = np.zeros((hi - lo) * wide, bool)
                        seen[np.concatenate(hits)] = True
                        common[lo:hi] = seen.reshape(-1, wide)[:, 1:].sum(axis=1)
                keep = pa.array(common >= share * (na + nb - common))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return over


def _with_both(pairs: DataFrame, prints: DataFrame, **columns: str) -> DataFrame:
    """Pairs with columns of the fingerprints of both sides: ``na``, ``nb`` and the given ones, with a and b behind their names."""
    for side in "ab":
        p = prints.select(F.col("rec").alias(side), F.col("n").alias(f"n{side}"), *(F.col(c).alias(f"{name}{side}") for name, c in columns.items()))
        pairs = pairs.join(p.hint("merge"), side)
    return pairs


def similar_pairs(records: DataFrame, share: float = 0.5, probes: int | None = PROBES) -> DataFrame:
    """``name_a``, ``name_b``: all pairs of records whose sets of 12-base words have at least ``share``
    of their union in common; a word and its reverse complement are one word.

    The fingerprint of a record has one of 2^24 bits for each word. Records with equal fingerprints
    are one class and are compared once. Each fingerprint is entered in cells by the two set bits
    that follow each of ``probes`` fixed bits (from every set bit, if it has few for that number); two records agree
    in a probe with a chance of about the square of their similarity, so a pair at 0.5 is missed with a chance of
    0.01 % and one at 0.6 of less than one in a million. With ``probes`` None every set bit is a cell and no pair can
    be missed, at the cost of one cell for each word. In a cell, pairs are joined by range of size; a cell of more than
    ``BLOCK`` records is cut into blocks over all tasks. Every candidate passes the Manhattan distance of the bit
    counts in 1,024 segments, a lower bound of the number of differing bits, before sequences are read, and
    is then verified exactly on the whole sequences.

    Null and empty fields and letters other than ACGT give no words; records without words are in
    no pair. A repeated name is one record. All pairs of a class come out, as the result demands, in groups of
    ``COPIES`` names. No records give no rows.
    """
    base = distinct_records(records, *FIELDS).withColumn("rec", F.monotonically_increasing_id())
    prints, facts = materialize(base.mapInArrow(lambda b: _fingerprints(b, probes), PRINT).where("n > 0"), F.count(F.lit(1)).alias("n"))
    one = prints.groupBy("digest").agg(F.min("rec").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes, most = materialize(one, F.coalesce(F.max("copies"), F.lit(0)).alias("most"))
    members, _ = materialize(join_hot_keys(prints.select("digest", "rec", "name"), classes, "digest", "copies", facts["n"]).select("rep", "name", "copies", F.expr(f"pmod(xxhash64(name), ceil(copies / {COPIES}D))").alias("part")))
    reps = prints.join(classes.select(F.col("rep").alias("rec")).hint("merge"), "rec", "left_semi")
    cells = reps.select(F.explode("keys").alias("key"), "rec", F.col("n").cast("long").alias("n"))
    close = cells.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs(share), "a long, b long, key long").distinct()
    close, seen = materialize(close, F.coalesce(F.sum((F.col("b") < 0).cast("long")), F.lit(0)).alias("large"))
    pairs = close.where("b >= 0").select("a", "b")
    if seen["large"]:
        large = close.where("b < 0").select("key", F.col("a").alias("rec")).join(prints.select("rec", F.col("n").cast("long").alias("n")), "rec")
        pairs = pairs.unionByName(_large_cells(large, share)).distinct()
    near = _with_both(pairs, prints, q="pops").mapInArrow(_bounded(share), "a long, b long")
    exact = _with_both(near, prints, p="packed").mapInArrow(_verify(share), "a long, b long")
    left, right = exact, members.where("copies > 1")
    if most["most"] > COPIES:
        parts = classes.where(F.col("copies") > COPIES).select("rep", F.ceil(F.col("copies") / COPIES).alias("parts"))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))
        for side in "ab":
            left = left.join(parts.withColumnRenamed("rep", side), side, "left").withColumn(f"part_{side}", each).drop("parts")
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("copies") / COPIES) - 1)))
    else:
        left = left.withColumn("part_a", F.lit(0).cast("long")).withColumn("part_b", F.lit(0).cast("long"))
    named = lambda side, name: members.select(F.col("rep").alias(side), F.col("part").alias(f"part_{side}"), F.col("name").alias(name)).hint("merge")
    between = left.join(named("a", "x"), ["a", "part_a"]).join(named("b", "y"), ["b", "part_b"]).select("x", "y")
    within = members.where("copies > 1").select("rep", "part", F.col("name").alias("x")).join(right.select("rep", "part", F.col("name").alias("y")).hint("merge"), ["rep", "part"]).where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))
