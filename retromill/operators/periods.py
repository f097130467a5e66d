"""Continuous periods and gaps of intervals that overlap, nest or stand apart (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retromill.shared import keep_partitions

NO_TAG = -(2**62)
SUMMARY = "part int, first_entity long, last_entity long, last_start long, max_end long"
PIECE = "entity long, island long, seg_end long, gap_start long, n long, tag long"


def _scan(batches: Iterator[pa.RecordBatch], entity: int | None, island: int, reach: int):
    """Walk rows sorted by (entity, start) with the state carried from the batch before: for each
    batch the entity, start, furthest end before the row within its entity, and island of each row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        e, s, t = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("entity", "s", "t"))
        new = np.append(entity is None or e[0] != entity, e[1:] != e[:-1])
        # the running maximum restarts with each entity: ends are lifted by more than their spread for each further entity
        order = np.cumsum(new)
        low, wide = min(int(t.min()), reach), max(int(t.max()), reach) - min(int(t.min()), reach) + 1
        if wide * (int(order[-1]) + 1) < 2**62:
            top = np.maximum.accumulate(np.append(reach - low if entity is not None else -1, (t - low) + order * wide))
            before = top[:-1] - order * wide + low
            last_reach = int(top[-1] - order[-1] * wide + low)
        else:
            before, now = np.empty_like(t), reach
            for i in range(len(t)):
                before[i] = now
                now = int(t[i]) if new[i] else max(now, int(t[i]))
            last_reach = now
        starts = new | (s > before)
        label = np.where(starts, s, 0)
        at = np.maximum.accumulate(np.where(starts, np.arange(len(s)), -1))
        label = np.where(at >= 0, label[np.maximum(at, 0)], island)
        tags = batch.column("tag").fill_null(NO_TAG).to_numpy(zero_copy_only=False).astype(np.int64)
        yield e, s, t, before, new, starts, label, tags
        entity, island, reach = int(e[-1]), int(label[-1]), last_reach


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = last = start = reach = None
    for e, _, t, _, _, _, label, _ in _scan(batches, None, 0, 0):
        first = int(e[0]) if first is None else first
        own = int(t[e == e[-1]].max())
        reach = max(reach, own) if last == int(e[-1]) else own
        last, start = int(e[-1]), int(label[-1])
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first_entity": [first], "last_entity": [last], "last_start": [start], "max_end": [reach]})


def _combine(rows: list) -> dict[int, tuple[int, int, int]]:
    """What each partition is given: (entity, start of the open island, furthest end) after all
    partitions before it."""
    state, given = None, {}
    for r in sorted(rows, key=lambda r: r.part):
        given[r.part] = state
        if state and state[0] == r.last_entity and r.last_start <= state[2]:
            state = (state[0], state[1], max(state[2], r.max_end))
        else:
            state = (r.last_entity, r.last_start, r.max_end)
    return given


def islands(rows: DataFrame, entity: str, start: str, end: str, tag: str | None = None) -> DataFrame:
    """``entity``, ``island`` (the start), ``seg_end``, ``gap_start`` (the end of the island before it in
    the entity, or null), ``n`` (intervals in it) and ``tag`` (the greatest ``tag`` of them) for each
    maximal stretch of overlapping or touching intervals.

    The intervals are range-sorted over all partitions by entity and start and written to the shared
    folder partition by partition, so an entity of any size is spread over many
    tasks. One pass gives a summary of each partition (its last entity, the start of that entity's
    last island, the furthest end). The summaries are as many as partitions, never more; a prefix
    over them gives each partition the state carried from those before it. The rescan with this
    state knows the island of every row, so partitions only emit one piece for each island they
    touch, and a grouping with partial maxima joins the pieces of islands that cross partitions.

    Rows with a null entity, start or end, and empty or reversed intervals are left out. Repeated
    intervals change nothing but ``n``. No intervals give no rows.
    """
    clean = rows.select(F.col(entity).cast("long").alias("entity"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("t"), (F.col(tag) if tag else F.lit(None)).cast("long").alias("tag"))
    clean = clean.where("entity is not null and s is not null and t is not null and s < t")
    placed = keep_partitions(clean.repartitionByRange("entity", "s").sortWithinPartitions("entity", "s", "t"))
    given = _combine(placed.mapInArrow(_summaries, SUMMARY).collect())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = given.get(TaskContext.get().partitionId())
        for e, s, t, before, new, starts, label, tags in _scan(batches, *(carried or (None, 0, 0))):
            cut = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (label[1:] != label[:-1])))
            has = (starts & ~new)[cut]
            most = np.maximum.reduceat(tags, cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(e[cut]), pa.array(label[cut]), pa.array(np.maximum.reduceat(t, cut)), pa.array(before[cut], mask=~has), pa.array(np.diff(np.append(cut, len(e)))), pa.array(most, mask=most == NO_TAG)],
                ["entity", "island", "seg_end", "gap_start", "n", "tag"],
            )

    found = placed.mapInArrow(pieces, PIECE)
    return found.groupBy("entity", "island").agg(F.max("seg_end").alias("seg_end"), F.max("gap_start").alias("gap_start"), F.sum("n").alias("n"), F.max("tag").alias("tag"))


def periods_and_gaps(rows: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """``kind`` ('period' or 'gap'), ``entity``, ``seg_start``, ``seg_end``: the maximal stretches of
    overlapping or touching intervals of each entity, and what lies between two neighbouring ones.
    See :func:`islands` for the method and for nulls, empty intervals and repeated rows."""
    both = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("entity"), F.col("island").alias("seg_start"), F.col("seg_end")),
        F.struct(F.lit("gap").alias("kind"), F.col("entity"), F.col("gap_start").alias("seg_start"), F.col("island").alias("seg_end")),
    )
    return islands(rows, entity, start, end).select(F.explode(both).alias("x")).where("x.seg_start is not null").select("x.*")


def merge_events(rows: DataFrame, entity: str, start: str, end: str, unit: str) -> DataFrame:
    """``entity``, ``orig_start``, ``orig_end``, ``unit_len``: overlapping or touching events of a sequence
    as one; an event that was merged with another keeps no unit (0)."""
    whole = islands(rows, entity, start, end, unit)
    return whole.select("entity", F.col("island").alias("orig_start"), F.col("seg_end").alias("orig_end"), F.when(F.col("n") == 1, F.coalesce("tag", F.lit(0))).otherwise(0).cast("long").alias("unit_len"))
