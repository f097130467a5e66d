"""Consensus sequences: column counts by Spark, alignment of single pairs by a small kernel."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retromill.config import Thresholds
from retromill.functions.dna import CODES, encode
from retromill.shared import materialize, spread

#: ambiguity codes of sets of bases (fixed values)
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M",
    "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N",
}


def iupac(bases: Column) -> Column:
    """The code of an array of bases: those that are A, C, G or T count, none at all is N."""
    table = F.create_map(*(F.lit(x) for pair in IUPAC.items() for x in pair))
    key = F.array_join(F.sort_array(F.array_distinct(F.filter(bases, lambda b: b.isin("A", "C", "G", "T")))), "")
    return F.coalesce(table[key], F.lit("N"))


#: columns of count tables that a task holds at once
HELD_COLUMNS = 1 << 20


def column_counts(rows: DataFrame, family: str, row: str) -> DataFrame:
    """``family``, ``col``, ``a``, ``c``, ``g``, ``t``: bases in each column of aligned rows. Other letters and
    gaps count for none; partial sums are made before the shuffle, so a family of any size is spread.
    The partial sums are small the more rows of one family lie in one partition."""
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    read = rows.where(F.col(row).isNotNull()).select(F.col(family).alias("family"), F.col(row).alias("row"))

    def sums(held: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(held), 64):
            part = list(held.items())[at : at + 64]
            lens = [len(c) for _, c in part]
            cells = np.concatenate([c for _, c in part])
            names = pa.array([f for f, _ in part], kind).take(pa.array(np.repeat(np.arange(len(part)), lens)))
            cols = np.concatenate([np.arange(n, dtype=np.int32) for n in lens])
            yield pa.RecordBatch.from_arrays([names, pa.array(cols), *(pa.array(np.ascontiguousarray(cells[:, k])) for k in range(4))], ["family", "col", "a", "c", "g", "t"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size, kind = 0, None
        for t in batches:
            kind = t.column(0).type
            codes, offsets = encode(t.column(1))
            for f, lo, hi in zip(t.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                c, n = held.get(f), hi - lo
                if c is None or len(c) < n:
                    more = np.zeros((n, 5), np.int64)
                    if c is not None:
                        more[: len(c)] = c
                    size += n - (0 if c is None else len(c))
                    held[f] = c = more
                c[np.arange(n), codes[lo:hi]] += 1
                if size > HELD_COLUMNS:
                    yield from sums(held, kind)
                    held, size = {}, 0
        yield from sums(held, kind)

    cells = read.mapInArrow(over, StructType([read.schema["family"], StructField("col", IntegerType()), *(StructField(b, LongType()) for b in "acgt")]))
    return cells.groupBy("family", "col").agg(*(F.sum(b).alias(b) for b in "acgt"))


def majority(counts: DataFrame, n: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``family``, ``consensus``, ``conservation`` and ``saturation`` (arrays, for each column the share of
    the ``n`` sequences with the most frequent base, and with any). A base with at least the
    threshold of a column's bases is taken, several as their ambiguity code; if there is none, those with at least
    ``t.ambiguity`` of the bases if that is set, else N; a column without bases is '-'."""
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    above = lambda least: F.filter(F.array(*(F.when(F.col(b.lower()) / total >= least, F.lit(b)) for b in "ACGT")), lambda b: b.isNotNull())
    bases = F.when(F.size(above(t.consensus)) > 0, above(t.consensus)).otherwise(above(t.ambiguity)) if t.ambiguity else above(t.consensus)
    letter = F.when(total == 0, "-").otherwise(iupac(bases))
    cols = counts.join(n, "family").select(
        "family", F.struct("col", letter.alias("base"), (F.greatest("a", "c", "g", "t") / F.col("n")).alias("cons"), (total / F.col("n")).alias("sat")).alias("x")
    )
    whole = cols.groupBy("family").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return whole.select("family", F.array_join("x.base", "").alias("consensus"), F.col("x.cons").alias("conservation"), F.col("x.sat").alias("saturation"))


def quick_consensus(counts: DataFrame) -> DataFrame:
    """``family``, ``consensus``: the most frequent base of each column, the first in the alphabet on a tie, N where there is
    none; without ambiguity codes."""
    most = F.greatest("a", "c", "g", "t")
    letter = F.when(most == 0, "N").when(F.col("a") == most, "A").when(F.col("c") == most, "C").when(F.col("g") == most, "G").otherwise("T")
    whole = counts.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("col", letter.alias("base")))).alias("x"))
    return whole.select("family", F.array_join("x.base", "").alias("consensus"))


def reversed_counts(counts: DataFrame) -> DataFrame:
    """The column counts of the other strand: columns from the end, A for T and C for G."""
    last = counts.groupBy("family").agg(F.max("col").alias("_last"))
    return counts.join(last, "family").select("family", (F.col("_last") - F.col("col")).alias("col"), F.col("t").alias("a"), F.col("g").alias("c"), F.col("c").alias("g"), F.col("a").alias("t"))


def merged_counts(left: DataFrame, right: DataFrame, aligned: DataFrame) -> DataFrame:
    """Two tables of column counts merged through alignments: ``family``, ``col``, ``a``, ``c``, ``g``, ``t``. ``aligned`` has
    ``family``, ``cigar`` once for each family, D for columns of ``left`` alone and I for those of ``right`` alone. Columns
    beyond the end of a table are left out, as is a family with a null or empty CIGAR; a family of any number of sequences is its columns only."""
    at = lambda ops: F.sum(F.when(F.col("s.op").isin(*ops), F.col("s.n")).otherwise(0)).over(Window.partitionBy("family").orderBy("k")) - F.when(F.col("s.op").isin(*ops), F.col("s.n")).otherwise(0)
    steps = aligned.where("cigar <> ''").select("family", F.posexplode(cigar_steps(F.col("cigar"))).alias("k", "s")).where("s.n > 0")
    steps = steps.select("family", F.col("s.op").alias("op"), F.col("s.n").alias("n"), at("MD").alias("la"), at("MI").alias("lb"), at("MDI").alias("lo"))
    each = steps.select("family", "op", "la", "lb", "lo", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    place = lambda c, ops: F.when(F.col("op").isin(*ops), F.col(c) + F.col("i"))
    cols = each.select("family", "op", (F.col("lo") + F.col("i")).alias("_o"), place("la", "MD").alias("_l"), place("lb", "MI").alias("_r"))
    side = lambda c, name, p: c.select("family", F.col("col").cast("long").alias(name), *(F.col(b).alias(p + b) for b in "acgt"))
    both = cols.join(side(left, "_l", "l_"), ["family", "_l"], "left").join(side(right, "_r", "r_"), ["family", "_r"], "left")
    there = F.when(F.col("op") == "M", F.col("l_a").isNotNull() & F.col("r_a").isNotNull()).otherwise(F.coalesce("l_a", "r_a").isNotNull())
    return both.where(there).select("family", F.col("_o").alias("col"), *((F.coalesce(f"l_{b}", F.lit(0)) + F.coalesce(f"r_{b}", F.lit(0))).alias(b) for b in "acgt"))


def boundaries(cons: DataFrame, n: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Adds ``first`` and ``last``: where the first run of conserved columns begins and the last one ends,
    counted from 0, or nulls. A run is shorter the more sequences there are."""
    bits = F.array_join(F.transform("conservation", lambda x: F.when(x >= threshold, "1").otherwise("0")), "")
    both = cons.join(n, "family").withColumn("_run", F.greatest(F.lit(2), 12 - F.floor(F.sqrt(F.greatest(F.col("n") - 2, F.lit(0)).cast("double")))).cast("int")).withColumn("_bits", bits)
    both = both.withColumn("_at", F.expr("locate(repeat('1', _run), _bits)")).withColumn("_back", F.expr("locate(repeat('1', _run), reverse(_bits))"))
    found = F.col("_at") > 0
    return both.withColumn("first", F.when(found, F.col("_at") - 1)).withColumn("last", F.when(found, F.length("_bits") - F.col("_back"))).drop("_run", "_bits", "_at", "_back", "n")


def trimmed(bounded: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``family``, ``seq``: the consensus between its boundaries, without columns that too few sequences
    have, gaps as N. Families without boundaries have no row."""
    kept = F.expr(f"filter(sequence(first, last), i -> saturation[i] >= {t.saturation}D)")
    letters = F.transform("_kept", lambda i: F.substring("consensus", (i + 1).cast("int"), F.lit(1)))
    b = bounded.where("first is not null").withColumn("_kept", kept)
    return b.select("family", F.translate(F.array_join(letters, ""), "-", "N").alias("seq"))


def target_site(rows: DataFrame, family: str, left: str, right: str, most: int = 13) -> DataFrame:
    """``family``, ``n_edges``, ``tsd_len``, ``n_match``, ``tsd_conf``, ``tsd_motif``: the target site
    duplication, the shortest length from 2 at which most members have the end of their left edge at
    the beginning of their right one, and the ambiguity codes of the matching ends. Members without
    one of the edges don't count; without any match the length is 0."""
    e = rows.select(F.col(family).alias("family"), F.upper(left).alias("l"), F.upper(right).alias("r")).where("length(l) > 0 and length(r) > 0")
    ks = F.expr(f"filter(sequence(2, {most}), k -> length(l) >= k and length(r) >= k and right(l, k) = left(r, k))")
    e = e.select("family", "r", ks.alias("ks"))
    n = e.groupBy("family").agg(F.count(F.lit(1)).alias("n_edges"))
    hits = e.select("family", F.explode("ks").alias("k"), F.expr("left(r, k)").alias("m"))
    best = hits.groupBy("family", "k").agg(F.count(F.lit(1)).alias("c")).groupBy("family").agg(F.min(F.struct((-F.col("c")).alias("less"), F.col("k").alias("k"))).alias("x"))
    best = best.select("family", F.col("x.k").alias("k"), (-F.col("x.less")).alias("n_match"))
    bases = hits.join(best, ["family", "k"]).select("family", F.posexplode(F.split("m", "")).alias("at", "base")).where("base <> ''").groupBy("family", "at").agg(F.collect_set("base").alias("b"))
    motif = bases.groupBy("family").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", iupac(F.col("b")).alias("x")))), lambda x: x["x"]), "").alias("tsd_motif"))
    return n.join(best, "family", "left").join(motif, "family", "left").select(
        "family", "n_edges", F.coalesce("k", F.lit(0)).alias("tsd_len"), F.coalesce("n_match", F.lit(0)).alias("n_match"), F.bround(F.coalesce("n_match", F.lit(0)) / F.col("n_edges"), 2).alias("tsd_conf"), F.coalesce("tsd_motif", F.lit("")).alias("tsd_motif")
    )


#: columns of an alignment whose bits are kept at once
BLOCK = 4096
FLIP = str.maketrans("ACGTacgt", "TGCAtgca")


def _sweep(bits: dict, text: str, n: int, vp: int, vn: int, d: int, kept: list) -> tuple[int, int, int]:
    """The columns of ``text`` in the table of edit distances, each as bits over the ``n`` rows: in ``kept`` for each
    where the diagonal step costs nothing, and where a row is one above the row before it."""
    ones, top = (1 << n) - 1, n - 1
    for x in text:
        eq = bits.get(x, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & ones
        hn = vp & d0
        hp = vn | (ones ^ (vp | d0))
        d += (hp >> top) - (hn >> top)
        hp = (hp << 1) | 1
        vn = hp & d0
        vp = ((hn << 1) | (ones ^ ((hp | d0) & ones))) & ones
        kept.append((d0, vp))
    return vp, vn, d


def _steps(a: str, b: str, band: int) -> tuple[int, list[tuple[int, str]]] | None:
    """Edit distance and runs of a global alignment with at most ``band`` edits; None beyond. On a tie the
    trace goes through a pair of letters, then through a letter of ``a`` alone. The table is kept as bits,
    a block of columns at a time."""
    n, m = len(a), len(b)
    if not n or not m or abs(n - m) > band:
        return None
    letters = np.frombuffer(a.encode("utf-32-le"), np.uint32)
    bits = {x: int.from_bytes(np.packbits(letters == ord(x), bitorder="little").tobytes(), "little") for x in set(a)}
    state, kept = ((1 << n) - 1, 0, n), []
    starts = []
    for at in range(0, m, BLOCK):
        starts.append(state)
        kept = []
        state = _sweep(bits, b[at : at + BLOCK], n, *state, kept)
        if state[2] - (m - min(at + BLOCK, m)) > band:
            return None
    d = state[2]
    runs: list[tuple[int, str]] = []
    block, i, j = len(starts) - 1, n, m
    while i or j:
        if j and (j - 1) // BLOCK != block:
            block, kept = (j - 1) // BLOCK, []
            _sweep(bits, b[block * BLOCK : (block + 1) * BLOCK], n, *starts[block], kept)
        d0, up = kept[j - 1 - block * BLOCK] if j else (0, 0)
        if i and j and (a[i - 1] == b[j - 1] or not d0 >> (i - 1) & 1):
            op, i, j = "M", i - 1, j - 1
        elif i and (not j or up >> (i - 1) & 1):
            op, i = "D", i - 1
        else:
            op, j = "I", j - 1
        if runs and runs[-1][1] == op:
            runs[-1] = (runs[-1][0] + 1, op)
        else:
            runs.append((1, op))
    return d, runs[::-1]


@lru_cache(64)
def _words(s: str, q: int) -> tuple[np.ndarray, np.ndarray]:
    codes = CODES[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)].astype(np.int64)
    at = np.zeros(max(len(s) - q + 1, 0), np.int64)
    for k in range(q):
        at = at * 5 + codes[k : k + len(at)]
    return np.unique(at, return_counts=True)


def _least_edits(a: str, b: str, q: int = 8) -> int:
    """No alignment of the two has fewer edits: each edit takes away at most ``q`` of their common words."""
    (x, nx), (y, ny) = _words(a, q), _words(b, q)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return max(0, -((int(np.minimum(nx[i], ny[j]).sum()) - max(len(a), len(b)) + q - 1) // q))


def _either_strand(a: str, b: str, band: int) -> tuple[bool, tuple[int, list[tuple[int, str]]]] | None:
    """The alignment of ``a`` with ``b`` or its reverse complement, whichever has fewer edits, as written on a
    tie. The strand with more common words is aligned first, the other one only if it may win."""
    turned = b.translate(FLIP)[::-1]
    least = _least_edits(a, b), _least_edits(a, turned)
    first = least[1] < least[0]
    found = _steps(a, turned if first else b, band)
    most = band if found is None else found[0] - (not first)
    if least[not first] <= most:
        other = _steps(a, b if first else turned, most)
        if other is not None:
            return not first, other
    return None if found is None else (first, found)


def align_pairs(pairs: DataFrame, a: str, b: str, edit_frac: float, strands: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``edits`` and ``cigar`` (M a pair of letters, D a letter of ``a`` alone, I one of ``b`` alone);
    null where a side is empty or the edits exceed ``edit_frac`` of the longer side, rounded down, by more than one. With ``strands`` ``b`` is
    turned where its reverse complement needs fewer edits, which ``is_rc`` tells. Pairs are spread by ``keys``, or all columns."""
    from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

    added = [StructField("is_rc", BooleanType())] * strands + [StructField("edits", IntegerType()), StructField("cigar", StringType())]
    pairs = spread(pairs, *(keys or pairs.columns))

    def one(x: str | None, y: str | None):
        if not x or not y:
            return None
        band = int(max(len(x), len(y)) * edit_frac) + 1
        if strands:
            return _either_strand(x, y, band)
        found = _steps(x, y, band)
        return found and (False, found)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            second = t.column(b).to_pylist()
            found = [one(x, y) for x, y in zip(t.column(a).to_pylist(), second)]
            columns = list(t.columns)
            if strands:
                columns[t.schema.get_field_index(b)] = pa.array([y.translate(FLIP)[::-1] if f and f[0] else y for f, y in zip(found, second)], pa.string())
                columns.append(pa.array([f and f[0] for f in found], pa.bool_()))
            columns += [pa.array([f and f[1][0] for f in found], pa.int32()), pa.array([f and "".join(f"{n}{op}" for n, op in f[1][1]) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*t.schema.names, *(x.name for x in added)])

    return pairs.mapInArrow(over, StructType([*pairs.schema.fields, *added]))


def cigar_steps(cigar: Column) -> Column:
    """A CIGAR as an array of (n, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MDI])"), F.lit(1)), lambda s: F.struct(F.regexp_extract(s, r"(\d+)", 1).cast("int").alias("n"), F.right(s, F.lit(1)).alias("op")))


def aligned_rows(aligned: DataFrame, seq: str, cigar: str) -> DataFrame:
    """Adds ``row``: the second sequence of each alignment in the columns of the first, '-' for its own
    letters that are missing; letters between columns are left out. The steps of a CIGAR are walked by
    a fold inside the expression, without Python."""
    fold = F.aggregate(
        cigar_steps(F.col(cigar)),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("row")),
        lambda s, c: F.struct(
            F.when(c["op"] == "D", s["at"]).otherwise(s["at"] + c["n"]).alias("at"),
            F.when(c["op"] == "M", F.concat(s["row"], F.substring(F.col(seq), s["at"], c["n"]))).when(c["op"] == "D", F.concat(s["row"], F.repeat(F.lit("-"), c["n"]))).otherwise(s["row"]).alias("row"),
        ),
    )
    return aligned.withColumn("row", F.when(F.col(cigar).isNotNull(), fold["row"]))


def star_rows(members: DataFrame, edit_frac: float = 0.5) -> DataFrame:
    """``family``, ``member``, ``is_rc``, ``edits``, ``cigar``, ``row``: each member aligned by itself to the ``centroid`` of its
    family, on the strand that needs fewer edits, in the centroid's columns. Members without a sequence, beyond
    the edits allowed, or of a family whose centroid has no sequence are kept with nulls. Members of a
    family meet in parts of about 64, so that counting their columns shuffles little."""
    whole = F.when(F.expr("member = centroid and length(seq) > 0"), F.col("seq"))
    heads = members.groupBy("family").agg(F.max(whole).alias("cseq"), F.count(F.lit(1)).alias("_n"))
    both = members.join(heads, "family").select("family", "member", "cseq", "seq", F.expr("pmod(xxhash64(member), ceil(_n / 64D))").alias("_part"))
    found = align_pairs(both, "cseq", "seq", edit_frac, strands=True, keys=("family", "_part"))
    return aligned_rows(found, "seq", "cigar").select("family", "member", "is_rc", "edits", "cigar", "row")


def sizes(rows: DataFrame) -> DataFrame:
    """``family``, ``n`` (aligned members), ``n_failed`` (members without a row), for families with a row."""
    return rows.groupBy("family").agg(F.count("row").alias("n"), F.sum(F.col("row").isNull().cast("long")).alias("n_failed")).where("n > 0")


def star_consensus(members: DataFrame, t: Thresholds = Thresholds(), edit_frac: float = 0.5) -> DataFrame:
    """``family``, ``n``, ``n_failed``, ``seq``: a consensus of each family, from ``family``, ``member``, ``seq`` and the
    ``centroid`` of the family. Each member is aligned to the centroid by itself (:func:`star_rows`), and its
    bases are counted in the centroid's columns; then majority, conserved boundaries and occupancy as above,
    over the members that could be aligned. Nothing but parts of families and column counts meets in a task."""
    rows, _ = materialize(star_rows(members, edit_frac).select("family", "row"))
    n = sizes(rows)
    cons = majority(column_counts(rows, "family", "row"), n.drop("n_failed"), t)
    return trimmed(boundaries(cons, n.drop("n_failed"), 2 * t.consensus), t).join(n, "family").select("family", "n", "n_failed", "seq")


def _inserted(cigar: str) -> Iterator[tuple[int, int, int]]:
    """For each insertion of a CIGAR the column before which it lies, where it begins in the member, and its length."""
    at = loc = 0
    for n, op in re.findall(r"(\d+)([MDI])", cigar):
        n = int(n)
        if op == "I":
            yield at, loc, n
        at += n * (op != "I")
        loc += n * (op != "D")


def insertion_widths(aligned: DataFrame, lengths: DataFrame) -> DataFrame:
    """``family``, ``ins``: the columns before which members have letters of their own, and how many columns these get: as
    many as the longest insertion there, but where all would be more than the consensus has letters, at most
    the greatest number at which they are not. ``lengths`` has ``family`` and ``len`` of the consensus."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            found = [(k, at, n) for k, c in enumerate(t.column(1).to_pylist()) for at, _, n in _inserted(c)]
            k, at, n = (np.array([x[c] for x in found], np.int32) for c in range(3))
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(k)), pa.array(at), pa.array(n)], ["family", "at", "n"])

    rows = aligned.where("cigar is not null").select("family", "cigar")
    widths = rows.mapInArrow(over, StructType([rows.schema["family"], StructField("at", IntegerType()), StructField("n", IntegerType())])).groupBy("family", "at").agg(F.max("n").alias("n"))
    ins = widths.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("ins")).join(lengths, "family")

    def capped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            made = []
            for ins, most in zip(t.column(1).to_pylist(), t.column(2).to_pylist()):
                wide = np.array([x["n"] for x in ins])
                low, high = 0, int(wide.max())
                while wide.sum() > most and low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if np.minimum(wide, mid).sum() <= most else (low, mid - 1)
                made.append([{"at": x["at"], "n": min(x["n"], high)} for x in ins])
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(made, t.schema.field(1).type)], t.schema.names[:2])

    return ins.select("family", "ins", "len").mapInArrow(capped, StructType([ins.schema["family"], ins.schema["ins"]]))


def with_insertions(aligned: DataFrame) -> DataFrame:
    """``row`` with the columns of ``ins`` put in, and ``n_cut``, how many letters had no column there."""
    from pyspark.sql.types import LongType, StructField, StructType

    def one(row: str | None, seq: str, cigar: str, ins: list | None) -> tuple[str | None, int | None]:
        if row is None:
            return None, None
        own = {at: seq[loc : loc + n] for at, loc, n in _inserted(cigar)}
        out, last, cut = [], 0, 0
        for x in ins or []:
            text = own.get(x["at"], "")
            cut += max(0, len(text) - x["n"])
            out += [row[last : x["at"]], text[: x["n"]].ljust(x["n"], "-")]
            last = x["at"]
        return "".join([*out, row[last:]]), cut

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            made = [one(*x) for x in zip(*(t.column(c).to_pylist() for c in ("row", "seq", "cigar", "ins")))]
            columns = list(t.columns)
            columns[t.schema.get_field_index("row")] = pa.array([r for r, _ in made], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in made], pa.int64())], [*t.schema.names, "n_cut"])

    return aligned.mapInArrow(over, StructType([*aligned.schema.fields, StructField("n_cut", LongType())]))


def consensus_rows(members: DataFrame, consensi: DataFrame, edit_frac: float = 0.5) -> DataFrame:
    """``family``, ``ord``, ``member``, ``is_rc``, ``edits``, ``cigar``, ``row``, ``n_cut``: the members (``family``, ``member``, ``seq``)
    aligned to the consensus of their family (``family``, ``cseq``) on the strand that needs fewer edits, with columns
    for insertions. The consensus itself has ``ord`` 0 and no member; a member that could not be aligned, or whose
    family has no consensus, is kept with nulls."""
    n = members.groupBy("family").agg(F.count(F.lit(1)).alias("_n"))
    both = members.join(n, "family").join(consensi, "family", "left").select("family", "member", "cseq", "seq", F.expr("pmod(xxhash64(member), ceil(_n / 64D))").alias("_part"))
    found = align_pairs(both, "cseq", "seq", edit_frac, strands=True, keys=("family", "_part"))
    found = aligned_rows(found, "seq", "cigar").select("family", F.lit(1).alias("ord"), "member", "seq", "is_rc", "edits", "cigar", "row")
    found, _ = materialize(found)
    own = consensi.select("family", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("member"), F.col("cseq").alias("seq"), F.lit(False).alias("is_rc"), F.lit(0).alias("edits"), F.concat(F.length("cseq").cast("string"), F.lit("M")).alias("cigar"), F.col("cseq").alias("row"))
    ins = insertion_widths(found, consensi.select("family", F.length("cseq").alias("len")))
    return with_insertions(found.unionByName(own).join(ins, "family", "left")).drop("seq", "ins")


def subfamily_tag(i: Column) -> Column:
    """a..z, aa..zz, aaa.. for 0-based numbers."""
    return F.repeat(F.char((i % 26 + 97).cast("long")), (F.floor(i / 26) + 1).cast("int"))


def percent(ident: float) -> float:
    """Divergence in percent, one digit, rounded as Python does."""
    return round((1.0 - ident) * 100.0, 1)

