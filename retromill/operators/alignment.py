"""Similarity of pairs of sequences by bounded edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retromill.config import Thresholds
from retromill.functions.edits import edit_distances
from retromill.functions.groups import numbers
from retromill.operators.coordinates import number_rows
from retromill.operators.seeds import anchored, pair_counts, usable_words, word_counts
from retromill.shared import materialize, spread


def f32(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


#: complement of the four bases, other letters as they are
FLIP = np.arange(256, dtype=np.uint8)
FLIP[np.frombuffer(b"ACGTacgt", np.uint8)] = np.frombuffer(b"TGCAtgca", np.uint8)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all strings end to end, and where each begins; a null is empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def _passes(short: np.ndarray, long_: np.ndarray, least: float) -> np.ndarray:
    return (short > 0) & ((short / np.maximum(long_, 1)).astype(np.float32) >= np.float32(least))


def _identity(edits: np.ndarray, longest: np.ndarray) -> np.ndarray:
    return np.maximum((1 - edits / np.maximum(longest, 1)).astype(np.float32), np.float32(0))


def verify(pairs: DataFrame, a: str, b: str, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds ``edits`` and ``ident`` (null where a pair fails) to ``pairs``, whose sequences (ASCII) are in columns
    ``a`` and ``b`` and left out of the result, ``pi`` and ``pj`` the anchor and ``is_rc`` whether the second is read on
    the other strand. Pairs whose shorter side has less than the coverage fail before any alignment. With an
    anchor inside both, the parts to its right and left are aligned apart and share the budget by
    length, and either that is beyond its own or empty fails the pair. A batch of pairs is aligned at once
    (:func:`edit_distances`), faster than the built-in distance of single strings is."""
    kept = [c for c in pairs.columns if c not in (a, b)]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            (ra, oa), (rb, ob) = _letters(x.column(a)), _letters(x.column(b))
            la, lb = np.diff(oa), np.diff(ob)
            rc, pi, pj = x.column("is_rc").to_numpy(zero_copy_only=False).astype(bool), numbers(x, "pi"), numbers(x, "pj")
            flipped = FLIP[rb][::-1]
            raw = np.concatenate((ra, rb, flipped))
            sa, sb = oa[:-1], len(ra) + np.where(rc, len(rb) + len(rb) - ob[1:], ob[:-1])
            longest = np.maximum(la, lb)
            covered = _passes(np.minimum(la, lb), longest, t.min_coverage)
            ca, cb = np.minimum(pi, la), np.minimum(np.where(rc, lb - pj - t.k, pj), lb)
            halves = covered & (ca > 0) & (cb > 0)
            budget = np.floor(longest * t.max_edit_frac).astype(np.int64) + 1
            right, left = np.maximum(la - ca, lb - cb), np.maximum(ca, cb)
            br = np.where(right + left > 0, budget * right // np.maximum(right + left, 1) + 1, budget // 2 + 1)
            bl = np.maximum(budget - br, 0)
            part = lambda size, other, own: np.where(own <= 0, np.maximum(size, other) // 4 + 1, own)
            h, w = np.flatnonzero(halves), np.flatnonzero(covered & ~halves)
            edits = np.full(len(la), -1, np.int64)
            edits[w] = edit_distances(raw, sa[w], la[w], sb[w], lb[w], part(la[w], lb[w], budget[w]))
            ea, eb = (la - ca)[h], (lb - cb)[h]
            dr = edit_distances(raw, (sa + ca)[h], ea, (sb + cb)[h], eb, part(ea, eb, br[h]))
            h, dr = h[dr >= 0], dr[dr >= 0]
            dl = edit_distances(raw, sa[h], ca[h], sb[h], cb[h], part(ca[h], cb[h], bl[h]))
            edits[h] = np.where(dl >= 0, dr + dl, -1)
            fails = edits < 0
            ident = _identity(edits, longest)
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in kept), pa.array(edits.astype(np.int32), mask=fails), pa.array(ident, mask=fails)], [*kept, "edits", "ident"])

    return pairs.mapInArrow(over, StructType([*(pairs.schema[c] for c in kept), *StructType.fromDDL("edits int, ident float").fields]))


def numbered_elements(records: DataFrame) -> DataFrame:
    """Elements in their canonical order, by full sequence and name, numbered from 0 as ``elem``. Only these two are
    sorted; the numbers are joined back by name."""
    order = number_rows(records.select("full_seq", "name"), "full_seq", "name", name="elem", keep=["name"])
    return records.join(order.withColumn("elem", F.col("elem") - 1), "name")


def ltr_sides(elements: DataFrame, n: int) -> DataFrame:
    """Left and right repeats in one space of identifiers: the left of element e is e, the right n + e."""
    both = F.array(F.struct(F.col("elem").alias("id"), F.col("ltr5").alias("seq")), F.struct((F.col("elem") + n).alias("id"), F.col("ltr3").alias("seq")))
    return elements.select(F.explode(both).alias("x")).select("x.*")


def _gated(sides: DataFrame, least: int) -> DataFrame:
    return sides.select("id", F.when(F.length("seq") >= least, F.col("seq")).otherwise("").alias("seq"))


def _with_sequences(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """Pairs with the sequences ``sa``, ``sb`` of ``i`` and ``j``, rows of one ``j`` together."""
    both = pairs.join(sides.select(F.col("id").alias("i"), F.col("seq").alias("sa")), "i")
    both = spread(both, "j").join(sides.select(F.col("id").alias("j"), F.col("seq").alias("sb")).hint("shuffle_hash"), "j")
    return both.sortWithinPartitions("j", "i")


def ltr_seeds(elements: DataFrame, n: int, t: Thresholds = Thresholds(), gate: int = 0) -> DataFrame:
    """Anchored pairs of repeats that share enough words, with both sequences (``sa``, ``sb``). Pairs are counted
    first, and only then are the words of each compared to find its anchor."""
    sides = ltr_sides(elements, n)
    among = usable_words(word_counts(sides, "id", "seq", t.k), 2 * t.max_bucket_ltr, t.k)
    pairs = pair_counts(sides, among, 1 / t.min_coverage, n, t.k).where(F.col("n") >= t.min_seed_shared).select("i", "j")
    if gate:
        sides = sides.where(F.length("seq") >= gate)
    return anchored(_with_sequences(pairs, sides), "sa", "sb", among, t.min_seed_shared, t.k)


def ltr_edges(elements: DataFrame, n: int, t: Thresholds = Thresholds()) -> DataFrame:
    """``i`` < ``j``, ``ltr_ident``: pairs of elements with a pair of repeats that passes; the best counts."""
    passed = verify(ltr_seeds(elements, n, t, t.min_ltr_len), "sa", "sb", t).where(F.col("ident") >= f32(t.min_identity))
    return passed.groupBy(F.least(F.col("i") % n, F.col("j") % n).alias("i"), F.greatest(F.col("i") % n, F.col("j") % n).alias("j")).agg(F.max("ident").alias("ltr_ident"))


def flank_matches(edges: DataFrame, elements: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The edges ``i``, ``j`` of which a flank of the one matches a flank of the other on either strand.
    Edges with a flank that is shorter than ``min_flank_len`` are not tested."""
    f = elements.where((F.length("flank_l") >= t.min_flank_len) & (F.length("flank_r") >= t.min_flank_len))
    both = edges.select("i", "j")
    for side in "ij":
        both = both.join(f.select(F.col("elem").alias(side), F.col("flank_l").alias(f"l{side}"), F.col("flank_r").alias(f"r{side}")), side)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own, other = ([_letters(x.column(c + side)) for c in "lr"] for side in "ij")
            match = np.zeros(x.num_rows, bool)
            for ra, oa in own:
                for rb, ob in other:
                    la, lb = np.diff(oa), np.diff(ob)
                    longest = np.maximum(la, lb)
                    budget = np.where(_passes(np.minimum(la, lb), longest, t.min_coverage), np.floor(longest * t.max_edit_frac).astype(np.int64) + 1, -1)
                    raw = np.concatenate((ra, rb, FLIP[rb][::-1]))
                    for start in (ob[:-1], len(rb) + len(rb) - ob[1:]):
                        d = edit_distances(raw, oa[:-1], la, len(ra) + start, lb, budget)
                        match |= (d >= 0) & (_identity(d, longest) >= np.float32(t.min_identity))
            yield x.select(["i", "j"]).filter(pa.array(match))

    return both.mapInArrow(over, "i long, j long").distinct()


def flank_filter(edges: DataFrame, elements: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Edges without those between copies of one insertion site: no flank may match."""
    return edges.join(flank_matches(edges, elements, t), ["i", "j"], "left_anti")


def internal_edges(passed: DataFrame, elements: DataFrame, t: Thresholds = Thresholds(), min_shared: int | None = None) -> DataFrame:
    """``i``, ``j``, ``ltr_ident``, ``int_ident``: the pairs of ``passed`` whose internal parts pass too. Only
    elements of passed pairs with a long enough internal part count for the words that are seeds, and pairs must share
    more words the longer the parts are on average. The pairs are known, so their words are compared pair by pair."""
    some = passed.select(F.explode(F.array("i", "j")).alias("elem")).distinct()
    inner = elements.join(some, "elem").where(F.length("internal") >= t.min_internal_len).select(F.col("elem").alias("id"), F.col("internal").alias("seq"))
    inner, facts = materialize(inner, F.coalesce(F.avg(F.length("seq")), F.lit(0.0)).alias("mean"))
    if min_shared is None:
        min_shared = max(t.min_seed_shared, int(facts["mean"] // 1000))
    among = usable_words(word_counts(inner, "id", "seq", t.k), t.max_bucket_internal, t.k)
    both = _with_sequences(passed.select("i", "j", "ltr_ident"), inner)
    both = both.where(F.greatest(F.length("sa"), F.length("sb")) <= F.least(F.length("sa"), F.length("sb")) * F.lit(1 / t.min_coverage))
    ok = verify(anchored(both, "sa", "sb", among, min_shared, t.k), "sa", "sb", t).where(F.col("ident") >= f32(t.min_identity))
    return ok.select("i", "j", "ltr_ident", F.col("ident").alias("int_ident"))


def family_edges(elements: DataFrame, n: int, t: Thresholds = Thresholds(), flanks: bool = True) -> DataFrame:
    """``i``, ``j``, ``ltr_div_pct``, ``int_div_pct``: the edges of the similarity graph, from records to percentages.
    Repeats pass, copies at one insertion site are left out (unless ``flanks`` is off), then internal parts pass."""
    passed, _ = materialize(ltr_edges(elements, n, t))
    if flanks:
        passed, _ = materialize(flank_filter(passed, elements, t))
    edges = internal_edges(passed, elements, t)
    pct = lambda c: F.bround((1 - F.col(c).cast("double")) * 100, 1)
    return edges.select("i", "j", pct("ltr_ident").alias("ltr_div_pct"), pct("int_ident").alias("int_div_pct"))
