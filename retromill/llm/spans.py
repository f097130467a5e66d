"""Long exact spans shared between records (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retromill.functions.dna import encode, pieces, scramble, valid_windows, word_codes
from retromill.functions.groups import whole_groups
from retromill.shared import join_hot_keys, materialize
from retromill.sources.records import distinct_records

BASE = 0x9E3779B97F4A7C15
ANCHOR = 24
#: an anchor is expected in at most so many runs for its runs to be compared within one task
IN_ONE_TASK = 20_000
#: up to so many hot anchors are broadcast; more are joined by a shuffle in which the runs of each are cut in so many parts
MOST_BROADCAST = 100_000
SALTS = 64
FIELDS = ("ltr5", "internal")
RUN = "anchor long, rec long, place long, bases binary"
INTERVAL = "rec long, field int, s long, e long"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, size = x, 1
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _pack(codes: np.ndarray, start: np.ndarray, length: np.ndarray, most: int) -> pa.Array:
    """Four bases to a byte; the last byte is filled with A."""
    wide = -(-most // 4) * 4
    at = start[:, None] + np.arange(wide)
    m = np.where(np.arange(wide) < length[:, None], codes[np.minimum(at, len(codes) - 1)], 0).reshape(len(start), -1, 4)
    packed = (m[:, :, 0] << 6 | m[:, :, 1] << 4 | m[:, :, 2] << 2 | m[:, :, 3]).astype(np.uint8)
    size = -(-length // 4)
    flat = packed[np.arange(wide // 4) < size[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(flat)])


def _unpack(column: pa.Array, most: int) -> np.ndarray:
    wide = -(-most // 4)
    column = column.cast(pa.binary())
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    m = data[np.minimum(off[:-1, None] + np.arange(wide), len(data) - 1)]
    return np.stack([m >> 6, m >> 4 & 3, m >> 2 & 3, m & 3], axis=2).reshape(len(column), -1)


def _window_hashes(bases: np.ndarray, size: int, n: int) -> np.ndarray:
    """Rabin-Karp hashes of the first ``n`` windows of each row, by doubling."""
    power, base, width = bases.astype(np.uint64) + np.uint64(1), np.uint64(BASE), 1
    out, done, rest = None, 0, size
    with np.errstate(over="ignore"):
        while True:
            if rest & 1:
                part = power[:, done : done + n]
                out = part if out is None else out * base + part
                done += width
            rest >>= 1
            if not rest:
                return scramble(out)
            power, base, width = power[:, : power.shape[1] - width] * base + power[:, width:], base * base, width * 2


def _runs(size: int, sample: int):
    """Cut each field into runs of windows with one anchor, the word of least hash in the window."""
    width = size - ANCHOR + 1

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec = batch.column("rec").to_numpy(zero_copy_only=False).astype(np.int64)
            for f, name in enumerate(FIELDS):
                codes, offsets = encode(batch.column(name))
                for part, off, of, begin in pieces(codes, offsets, size - 1):
                    ok = valid_windows(part, off, size)
                    if not ok.any():
                        continue
                    h = scramble(word_codes(part, ANCHOR)) >> np.uint64(24) << np.uint64(24)
                    least = _sliding_min(h | np.arange(len(h), dtype=np.uint64), width)
                    first = np.flatnonzero(ok & np.append(True, (least[1:] != least[:-1]) | ~ok[:-1]))
                    last = np.flatnonzero(ok & np.append((least[1:] != least[:-1]) | ~ok[1:], True))
                    anchor = (least[first] >> np.uint64(24)).astype(np.int64)
                    if sample:
                        yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])
                        continue
                    s = np.searchsorted(off, first, "right") - 1
                    n = last - first + 1
                    place = ((first - off[s] + begin[s]) << 9) | (n << 1) | f
                    for i in range(0, len(first), 20_000):
                        j = slice(i, i + 20_000)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(anchor[j]), pa.array(rec[of[s[j]]]), pa.array(place[j]), _pack(part, first[j], n[j] + size - 1, width + size - 1)], ["anchor", "rec", "place", "bases"]
                        )

    return over


def _intervals(rec: np.ndarray, place: np.ndarray, shared: np.ndarray, size: int) -> pa.RecordBatch:
    """The stretches covered by the shared windows of each run."""
    edge = np.zeros((len(rec), shared.shape[1] + 2), np.int8)
    edge[:, 1:-1] = shared
    step = np.diff(edge, axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    start = place[row] >> 9
    return pa.RecordBatch.from_arrays([pa.array(rec[row]), pa.array((place[row] & 1).astype(np.int32)), pa.array(start + a), pa.array(start + b - 1 + size)], ["rec", "field", "s", "e"])


def _compare(size: int):
    """Rows sorted by anchor: the windows that occur in more than one record."""
    width = size - ANCHOR + 1

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, rec = (t.column(c).to_numpy().astype(np.int64) for c in ("anchor", "rec"))
        if not len(anchor):
            return
        begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        many = np.minimum.reduceat(rec, begin) != np.maximum.reduceat(rec, begin)
        keep = np.repeat(many, np.diff(np.append(begin, len(anchor))))
        if not keep.any():
            return
        t, anchor, rec = t.filter(pa.array(keep)), anchor[keep], rec[keep]
        place = t.column("place").to_numpy().astype(np.int64)
        n = (place >> 1) & 255
        with np.errstate(over="ignore"):
            h = _window_hashes(_unpack(t.column("bases").combine_chunks(), width + size - 1), size, width) ^ (anchor.astype(np.uint64) * np.uint64(BASE))[:, None]
        real = np.arange(width) < n[:, None]
        flat, who = h[real], np.repeat(rec, n)
        order = np.argsort(flat)
        flat, who = flat[order], who[order]
        begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        many = np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)
        hit = np.empty(len(flat), bool)
        hit[order] = np.repeat(many, np.diff(np.append(begin, len(flat))))
        shared = np.zeros(real.shape, bool)
        shared[real] = hit
        yield _intervals(rec, place, shared, size)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "anchor"):
            yield from found(pa.Table.from_batches([batch]))

    return over


def _parted(runs: DataFrame, hot: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The runs without and with the ``n`` hot anchors. The runs of a hot anchor never meet in one task for it."""
    if n <= MOST_BROADCAST:
        return tuple(runs.join(F.broadcast(hot), "anchor", how) for how in ("left_anti", "left_semi"))
    salted = runs.withColumn("salt", F.pmod("rec", F.lit(SALTS)))
    keys = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return tuple(salted.join(keys, ["anchor", "salt"], how).select(*runs.columns) for how in ("left_anti", "left_semi"))


def _hot_intervals(runs: DataFrame, size: int) -> DataFrame:
    """The same for runs of anchors that very many runs have: equal runs are reduced to one state,
    each window is counted by its hash over all states with partial aggregation, and the marks come
    back by joins in which hot keys are broadcast."""
    width = size - ANCHOR + 1

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                t = batch.slice(i, 2000)
                n = t.column("n_windows").to_numpy(zero_copy_only=False).astype(np.int64)
                real = np.arange(width) < n[:, None]
                h = _window_hashes(_unpack(t.column("bases"), width + size - 1), size, width)[real]
                row, at = np.nonzero(real)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.astype(np.int64)), t.column("bases").take(pa.array(row)), t.column("n_windows").take(pa.array(row)), t.column("lo").take(pa.array(row)), t.column("hi").take(pa.array(row)), pa.array(np.int64(1) << at)],
                    ["h", "bases", "n_windows", "lo", "hi", "bit"],
                )

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rec, place, mask = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rec", "place", "mask"))
            yield _intervals(rec, place, (mask[:, None] >> np.arange(width) & 1).astype(bool), size)

    runs, facts = materialize(runs.withColumn("n_windows", F.expr("cast(shiftright(place, 1) & 255 as int)")), F.count(F.lit(1)).alias("n"))
    states, _ = materialize(runs.groupBy("bases", "n_windows").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi"), F.count(F.lit(1)).alias("n")))
    windows, seen = materialize(states.mapInArrow(explode, "h long, bases binary, n_windows int, lo long, hi long, bit long"), F.count(F.lit(1)).alias("n"))
    shared, _ = materialize(windows.groupBy("h").agg(F.min("lo").alias("lo2"), F.max("hi").alias("hi2"), F.count(F.lit(1)).alias("m")).where("lo2 <> hi2"))
    marked = join_hot_keys(windows.select("h", "bases", "n_windows", "bit"), shared.select("h", "m"), "h", "m", seen["n"])
    masks = marked.groupBy("bases", "n_windows").agg(F.bit_or("bit").alias("mask"))
    side, _ = materialize(masks.join(states.select("bases", "n_windows", "n"), ["bases", "n_windows"]).select(F.struct("bases", "n_windows").alias("run"), "mask", "n"))
    rows = join_hot_keys(runs.select(F.struct("bases", "n_windows").alias("run"), "rec", "place"), side, "run", "n", facts["n"])
    return rows.select("rec", "place", "mask").mapInArrow(back, INTERVAL)


def shared_spans(records: DataFrame, size: int = 80, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``name``, ``field``, ``shared_len``: the bases of each field that lie in a stretch of at least
    ``size`` bases that also occurs in a field of another record; rows only where there are any.

    Every window of ``size`` bases gets a Rabin-Karp hash and is counted; the windows found in more
    than one record merge into maximal intervals. To keep the hashes of all windows out of the
    shuffle, consecutive windows with the same anchor (the 24-base word of least hash, which depends
    on the window's bases alone, so equal windows have equal anchors) travel together as one run of
    packed bases, about a thirtieth as many rows, and are hashed where they are counted. Anchors
    with more than about ``in_one_task`` runs, a number that does not grow with the data, are found from a sixteenth
    of the records; for these every window is counted by its own hash with partial aggregation. The sample only chooses
    between two exact ways.

    Null and empty fields, fields shorter than ``size`` and letters other than ACGT give no windows.
    A repeated name is one record, so its copies share nothing with each other. A string of any
    length is cut into overlapping pieces. No records give no rows.
    """
    width = size - ANCHOR + 1
    if not 1 <= width <= 62:
        raise ValueError("size must be 24 to 85")
    base = distinct_records(records, *FIELDS).withColumn("rec", F.monotonically_increasing_id())
    base, _ = materialize(base.select("rec", "name", *FIELDS))
    hot = base.where("pmod(rec, 16) = 0").mapInArrow(_runs(size, 1), "anchor long").groupBy("anchor").count().where(F.col("count") * 16 > in_one_task).select("anchor")
    hot, some = materialize(hot, F.count(F.lit(1)).alias("n"))
    runs = base.mapInArrow(_runs(size, 0), RUN)
    cold, often = _parted(runs, hot, some["n"]) if some["n"] else (runs, None)
    found = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(size), INTERVAL)
    if some["n"]:
        found = found.unionByName(_hot_intervals(often, size))
    before = F.max("e").over(Window.partitionBy("rec", "field").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    lengths = found.withColumn("from", F.greatest("s", F.coalesce(before, F.lit(0)))).groupBy("rec", "field").agg(F.sum(F.greatest(F.col("e") - F.col("from"), F.lit(0))).alias("shared_len"))
    names = F.when(F.col("field") == 0, FIELDS[0]).otherwise(FIELDS[1])
    return lengths.join(base.select("rec", "name"), "rec").select("name", names.alias("field"), "shared_len")
