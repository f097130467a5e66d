"""Frequency of every distinct word of bases (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retromill.functions.dna import encode, pieces, string_of_position, valid_windows, word_codes
from retromill.sources.records import distinct_records

FIELDS = ("ltr5", "internal")
#: records of one block of the vertical layout; a local identifier then has 12 bits
BLOCK = 4096
#: neighbouring terms that share a row of the layout
TERMS = 1024


#: occurrences after which the part of a block that is held is passed on
HELD = 1 << 23
HEAD = np.dtype([("block", np.int64), ("bitmap", np.int32), ("extra", np.int32), ("split", np.int32), ("pad", np.int32)])


def _pack_block(packed: np.ndarray, bits: int, records: int, block: int, split: bool) -> Iterator[pa.RecordBatch]:
    """``packed``: term << 12 | record, for each occurrence in one block, or with ``split`` a part of it. For each
    group of terms: the cardinalities, the identifiers (a sorted list, or a bitmap where that is smaller) and the
    occurrences beyond the first of each record."""
    packed.sort()
    new = np.append(True, packed[1:] != packed[:-1]) if len(packed) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    pair = packed[at]
    term, rec = (pair >> 12).astype(np.int64), (pair & 4095).astype(np.uint16)
    times = np.diff(np.append(at, len(packed)))
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    terms, card = term[begin], np.diff(np.append(begin, len(term)))
    occ = np.add.reduceat(times, begin) if len(term) else times
    groups, n_groups = terms // TERMS, (1 << bits) // TERMS or 1
    cut = np.searchsorted(groups, np.arange(n_groups + 1))
    bitmap_bytes = -(-records // 8)
    out: dict[str, list] = {"bucket": [], "payload": []}
    for g in range(n_groups):
        a, b = int(cut[g]), int(cut[g + 1])
        if a == b:
            continue
        counts = np.zeros(TERMS, np.uint16)
        counts[terms[a:b] % TERMS] = card[a:b]
        lo, hi = int(begin[a]), int(begin[b - 1] + card[b - 1])
        wide = np.flatnonzero(card[a:b] * 2 > bitmap_bytes)
        parts = []
        done = lo
        for w in wide + a:
            parts.append(rec[done : begin[w]].tobytes())
            done = int(begin[w] + card[w])
            marks = np.zeros(bitmap_bytes * 8, bool)
            marks[rec[begin[w] : done]] = True
            parts.append(np.packbits(marks).tobytes())
        more = occ[a:b] - card[a:b]
        extra = np.flatnonzero(more)
        head = np.array([(block, bitmap_bytes, len(extra), split, 0)], HEAD).tobytes()
        out["bucket"].append(g)
        out["payload"].append(b"".join([head, counts.tobytes(), (terms[a:b][extra] % TERMS).astype(np.uint16).tobytes(), more[extra].astype(np.int64).tobytes(), *parts, rec[done:hi].tobytes()]))
        if len(out["bucket"]) == 64:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), "payload": pa.array(out["payload"], pa.binary())})
            out = {"bucket": [], "payload": []}
    if out["bucket"]:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), "payload": pa.array(out["payload"], pa.binary())})


def _layout(k: int, most: int, limit: int):
    """Blocks of the vertical layout from batches of records. A block of texts so long that their words may not be
    held at once is passed on in parts under one number."""
    step = min(512, most)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        records = size = 0
        split = False
        block = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                yield from _pack_block(np.concatenate(held), 2 * k, most if split else records, block, split)
            held, size = [], 0

        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                if records + batch.num_rows > most or size > limit:
                    yield from flush()
                    records, split, block = 0, False, block + 1
                for name in FIELDS:
                    codes, offsets = encode(batch.column(name))
                    for part, off, of, _ in pieces(codes, offsets, k - 1, min(1 << 22, limit)):
                        ok = valid_windows(part, off, k)
                        if not len(ok):
                            continue
                        if size + len(ok) > 2 * limit:
                            split = True
                            yield from flush()
                        word = word_codes(part, k, np.uint32)
                        who = of[string_of_position(off, len(word))].astype(np.uint32) + np.uint32(records)
                        held.append(((word << np.uint32(12)) | who)[ok])
                        size += len(held[-1])
                records += batch.num_rows
        yield from flush()

    return over


def _sets(payload: bytes) -> tuple[int, bool, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """What a row of the layout holds: block, whether it is a part of one, cardinality of each term's list, the lists
    end to end, the bitmaps with their terms, and the terms with further occurrences and how many."""
    head = np.frombuffer(payload, HEAD, 1)[0]
    wide, n = int(head["bitmap"]), int(head["extra"])
    counts = np.frombuffer(payload, np.uint16, TERMS, HEAD.itemsize).astype(np.int64)
    at = HEAD.itemsize + 2 * TERMS
    which, more = np.frombuffer(payload, np.uint16, n, at), np.frombuffer(payload, np.int64, n, at + 2 * n)
    at += 10 * n
    is_map = counts * 2 > wide
    begin = at + np.append(0, np.cumsum(np.where(is_map, wide, counts * 2)))
    if begin[-1] != len(payload):
        raise ValueError("a block of the term layout is damaged")
    maps = [(int(t), np.frombuffer(payload, np.uint8, wide, int(begin[t]))) for t in np.flatnonzero(is_map)]
    cut = [at, *(x for t, _ in maps for x in (int(begin[t]), int(begin[t + 1]))), len(payload)]
    lists = np.concatenate([np.frombuffer(payload[a:b], np.uint16) for a, b in zip(cut[::2], cut[1::2])])
    return int(head["block"]), bool(head["split"]), np.where(is_map, 0, counts), lists, maps, which, more


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the rows of each group of terms by union of their sets, and read the cardinalities. Sets of
    different blocks hold different records; the parts of one block, which all come from one task, may hold the same
    ones and are united identifier by identifier."""
    state: dict[int, np.ndarray] = {}
    parts: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()):
            block, split, size, lists, maps, which, more = _sets(payload)
            own = state.setdefault(bucket, np.zeros((2, TERMS), np.int64))
            found = np.bincount(np.repeat(np.arange(TERMS), size)[: len(lists)], minlength=TERMS)
            for t, bits in maps:
                found[t] = np.bitwise_count(bits).sum()
            own[1] += found
            own[1][which] += more
            if not split:
                own[0] += found
                continue
            ids = [np.repeat(np.arange(TERMS), size) << 12 | lists, *(t << 12 | np.flatnonzero(np.unpackbits(bits)) for t, bits in maps)]
            parts.setdefault((bucket, block), []).append(np.concatenate(ids).astype(np.int32))
    for (bucket, _), ids in parts.items():
        state[bucket][0] += np.bincount(np.unique(np.concatenate(ids)) >> 12, minlength=TERMS)
    for bucket in sorted(state):
        df, occ = state[bucket]
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(t + bucket * TERMS), pa.array(occ[t]), pa.array(df[t])], ["code", "n_occ", "n_records"])


def term_frequencies(records: DataFrame, k: int = 10, common_share: float = 0.02) -> DataFrame:
    """``term``, ``n_occ``, ``n_records`` and ``mark`` of each distinct word of ``k`` (at most 10)
    bases in ``ltr5`` and ``internal``: how often it occurs, overlaps included, in how many records,
    and 'rare' if in exactly one, 'common' if in more than ``common_share`` of all records, else
    'usable'.

    Vertical layout: for each group of neighbouring terms and each block of up to 4,096 records one
    row holds the set of records with each term, a list of 12-bit identifiers or a bitmap, whichever
    is smaller, and beside it the counters of further occurrences; very long texts spread their block over several
    rows. The sets are merged by union, twice: first in partitions by group of terms, which Spark cuts to even sizes
    however frequent a term is, then one row for each term. Document frequency is the cardinality of the union.

    Null and empty fields and letters other than ACGT give no words; a repeated name is one record;
    a record without words counts among all records. No records give no rows.
    """
    if not 1 <= k <= 10:
        raise ValueError("k must be 1 to 10")
    base = distinct_records(records, *FIELDS)
    blocks = base.mapInArrow(_layout(k, BLOCK, HELD), "bucket int, payload binary")
    total = records.where("name is not null").select("name").distinct().count()
    merged = blocks.hint("rebalance", "bucket").mapInArrow(_read, "code long, n_occ long, n_records long")
    sums = merged.groupBy("code").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_records").alias("n_records"))
    digits = F.lpad(F.conv(F.col("code").cast("string"), 10, 4), k, "0")
    mark = F.when(F.col("n_records") == 1, "rare").when(F.col("n_records") > F.lit(total * common_share), "common").otherwise("usable")
    return sums.select(F.translate(digits, "0123", "ACGT").alias("term"), "n_occ", "n_records", mark.alias("mark"))
