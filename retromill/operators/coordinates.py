"""Order, offsets and coordinate maps of sequences with parts taken out.

Intervals are 0-based and half-open. A map is a table of removed intervals: ``entity``,
``orig_start``, ``orig_end``, ``unit_len`` (bases kept at the start of the interval)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retromill.operators.periods import merge_events, periods_and_gaps
from retromill.shared import keep_partitions

#: bases of a bin for joins and running sums along a sequence
BIN = 1 << 16


def number_rows(rows: DataFrame, *keys: str | Column, name: str = "ordinal", keep: list[str] | None = None) -> DataFrame:
    """Number all rows from 1 in the order of ``keys``, over all partitions: a range sort, the number
    of rows of each partition, and a prefix sum over these. Equal keys keep an arbitrary order, so
    give keys that are unique. Only the columns ``keep``, if given, are written and come out."""
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = keep_partitions(placed.select(*(keep or rows.columns), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = sizes.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = placed.join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_row") - F.col("_first") + F.col("_before") + 1).drop("_part", "_row", "_first", "_before")


def running_sum(rows: DataFrame, key: str, order: str, value: str, name: str, width: int = BIN, fan: int | None = None) -> DataFrame:
    """The sum of ``value`` over the rows of the same ``key`` with a smaller ``order`` (a number, unique
    within the key). Sums by bins of ``order`` are cumulated first, so no task gets all rows of a key; with ``fan`` these
    in turn by bins of so many of them, for keys of very many bins."""
    binned = rows.withColumn("_bin", F.floor(F.col(order) / width).cast("long"))
    sums = binned.groupBy(key, "_bin").agg(F.sum(value).alias("_sum"))
    if fan:
        base = running_sum(sums.withColumnRenamed("_bin", "_at"), key, "_at", "_sum", "_so_far", fan).select(key, F.col("_at").alias("_bin"), F.col("_so_far").alias("_base"))
    else:
        base = sums.select(key, "_bin", (F.sum("_sum").over(Window.partitionBy(key).orderBy("_bin")) - F.col("_sum")).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy(key, "_bin").orderBy(order)) - F.col(value)
    return binned.withColumn("_inside", inside).join(base, [key, "_bin"]).withColumn(name, F.col("_inside") + F.col("_base")).drop("_bin", "_inside", "_base")


def contig_offsets(contigs: DataFrame) -> DataFrame:
    """Where each contig begins in its scaffold: lengths and gaps before it. ``contigs`` has
    ``scaffold``, ``ord``, ``len``; a null length counts as 0."""
    return running_sum(contigs.withColumn("len", F.coalesce("len", F.lit(0))), "scaffold", "ord", "len", "offset", 1000)


def resolve_scaffolds(wanted: DataFrame, sequences: DataFrame) -> DataFrame:
    """``scaffold``, ``seq_index``: the sequence of each wanted name, by its whole description line (name, blank,
    description) before its name alone; null if neither is there. Of equal lines the first sequence counts."""
    full = F.concat("name", F.lit(" "), "descr")
    first = lambda key: sequences.where(key.isNotNull()).groupBy(key.alias("scaffold")).agg(F.min("seq_index").alias("i"))
    whole, alone = first(F.when(F.col("descr") != "", full)).withColumnRenamed("i", "a"), first(F.col("name")).withColumnRenamed("i", "b")
    return wanted.select("scaffold").distinct().join(whole, "scaffold", "left").join(alone, "scaffold", "left").select("scaffold", F.coalesce("a", "b").alias("seq_index"))


def extract_elements(alignments: DataFrame, scaffolds: DataFrame, flank: int = 100) -> DataFrame:
    """Elements from pairs of repeats: numbered names in the order of (scaffold, r1s, r2s), footprint
    with up to ``flank`` bases to each side, clipped to the scaffold. Alignments with an empty repeat,
    null coordinates, on a scaffold that is not there or has no length, or beyond its end are left
    out; a repeated ``aln_id`` is one alignment."""
    some = alignments.where("aln_id is not null").groupBy("aln_id").agg(F.max(F.struct("loaded_at", "scaffold_idx", "r1s", "r1e", "r2s", "r2e", "round")).alias("x")).select("aln_id", "x.*")
    some = some.where("r1e - r1s <> 0 and r2e - r2s <> 0 and r2e is not null and r1s is not null")
    known = some.join(scaffolds.select(F.col("seq_index").alias("scaffold_idx"), F.col("name").alias("scaffold"), "scaf_len"), "scaffold_idx").where("r2e <= scaf_len")
    placed = known.withColumn("fl_s", F.greatest(F.col("r1s") - flank, F.lit(0))).withColumn("fr_e", F.least(F.col("r2e") + flank, F.col("scaf_len")))
    return number_rows(placed, "scaffold_idx", "r1s", "r2s", "aln_id").withColumn("name", F.concat(F.lit("LTR_"), F.col("ordinal").cast("string")))


def element_header(e: DataFrame) -> DataFrame:
    """``name``, ``header``: the description line of each extracted element."""
    text = F.format_string(">%s scaffold=%s flank_l=%d-%d repeat1=%d-%d repeat2=%d-%d flank_r=%d-%d", "name", "scaffold", "fl_s", "r1s", "r1s", "r1e", "r2s", "r2e", "r2e", "fr_e")
    return e.select("name", text.alias("header"))


def extract_sequences(wanted: DataFrame, pieces: DataFrame, width: int = BIN) -> DataFrame:
    """``name``, ``seq``: the bases from ``s`` to ``e`` of each row of ``wanted`` (``name``, ``entity``, ``s``, ``e``), cut out
    of sequences that lie in ``pieces`` (``entity``, ``start``, ``seq``) of any size, such as a chromosome's. Both are
    entered in the bins they touch, so a long sequence is many tasks; only the parts of one stretch meet in one row.
    Stretches are cut at the ends of what is there; of those that lie beyond it, empty or with nulls ``seq`` is ''."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    p = pieces.where("length(seq) > 0 and start is not null").select(F.col("entity").alias("_entity"), F.col("start").cast("long").alias("_a"), (F.col("start") + F.length("seq")).alias("_b"), "seq")
    p = p.withColumn("_bin", bins(F.col("_a"), F.col("_b")))
    w = wanted.where("s < e").select("name", "entity", "s", "e").withColumn("_wbin", bins(F.col("s"), F.col("e")))
    lo, hi = F.greatest("s", "_a"), F.least("e", "_b")
    hit = w.join(p, (F.col("entity") == F.col("_entity")) & (F.col("_wbin") == F.col("_bin")) & (lo < hi) & (F.floor(lo / width) == F.col("_bin")))
    part = F.struct(lo.alias("at"), F.substring("seq", (lo - F.col("_a") + 1).cast("int"), (hi - lo).cast("int")).alias("x"))
    whole = hit.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["x"]), "").alias("seq"))
    return wanted.select("name").distinct().join(whole, "name", "left").select("name", F.coalesce("seq", F.lit("")).alias("seq"))


def scan_windows(events: DataFrame, lengths: DataFrame, flank: int = 32768) -> DataFrame:
    """``entity``, ``win_start``, ``win_end``: events widened by ``flank`` to both sides within their
    sequence, overlapping ones as one. Sequences of null length have no windows."""
    wide = events.join(lengths, "entity").where("len is not null").select("entity", F.greatest(F.col("orig_start") - flank, F.lit(0)).alias("s"), F.least(F.col("orig_end") + flank, F.col("len")).alias("t"))
    return periods_and_gaps(wide, "entity", "s", "t").where("kind = 'period'").select("entity", F.col("seg_start").alias("win_start"), F.col("seg_end").alias("win_end"))


def kept_segments(events: DataFrame, lengths: DataFrame) -> DataFrame:
    """``entity``, ``seg_start``, ``seg_end``: what remains of each sequence when the events are taken
    out: the gaps between them and the two ends; a sequence without events remains whole. Sequences
    of null length have no end and are left out; so are events beyond the end."""
    inside = events.join(lengths, "entity").where("len is not null and orig_start < len").select("entity", "orig_start", F.least("orig_end", "len").alias("orig_end"), "len")
    both = periods_and_gaps(inside, "entity", "orig_start", "orig_end")
    gaps = both.where("kind = 'gap'").select("entity", "seg_start", "seg_end")
    edge = both.where("kind = 'period'").groupBy("entity").agg(F.min("seg_start").alias("first"), F.max("seg_end").alias("last"))
    ends = lengths.where("len is not null").join(edge, "entity", "left")
    whole = F.when(F.col("first").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("seg_start"), F.col("len").alias("seg_end"))))
    sides = F.array(F.struct(F.lit(0).cast("long").alias("seg_start"), F.col("first").alias("seg_end")), F.struct(F.col("last").alias("seg_start"), F.col("len").alias("seg_end")))
    outer = ends.select("entity", F.explode(F.coalesce(whole, sides)).alias("x")).select("entity", "x.*").where("seg_start < seg_end")
    return gaps.unionByName(outer)


def with_shifts(events: DataFrame) -> DataFrame:
    """Merged events with ``removed`` (bases taken out), ``shift`` (taken out before them) and ``at``
    (where they are in the shortened sequence, after the kept unit)."""
    merged = merge_events(events, "entity", "orig_start", "orig_end", "unit_len")
    merged = merged.withColumn("unit_len", F.least("unit_len", F.col("orig_end") - F.col("orig_start"))).withColumn("removed", F.col("orig_end") - F.col("orig_start") - F.col("unit_len"))
    return running_sum(merged, "entity", "orig_start", "removed", "shift").withColumn("at", F.col("orig_start") + F.col("unit_len") - F.col("shift"))


def _last_before(points: DataFrame, steps: DataFrame, key: str, point: str, step: str, keep: list[str], width: int = BIN) -> DataFrame:
    """As-of join: to each point the last step of its key at or before it, or nulls. Both are cut into
    bins; the last step before each bin is carried over the bins, so tasks get bins, not keys."""
    width_of = lambda c: F.floor(F.col(c) / width).cast("long")
    step_row = F.struct(F.col(step).alias("_at"), *keep)
    s = steps.select(key, width_of(step).alias("_bin"), F.col(step).alias("_pos"), step_row.alias("_step"))
    tail = s.groupBy(key, "_bin").agg(F.max("_step").alias("_step"))
    bins = points.select(key, width_of(point).alias("_bin")).distinct().withColumn("_step", F.lit(None).cast(tail.schema["_step"].dataType))
    over = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = tail.unionByName(bins).groupBy(key, "_bin").agg(F.max("_step").alias("_step")).select(key, "_bin", F.last("_step", ignorenulls=True).over(over).alias("_carry"))
    p = points.withColumn("_bin", width_of(point)).withColumn("_pos", F.col(point)).withColumn("_real", F.lit(1))
    both = p.unionByName(s.withColumn("_real", F.lit(0)), allowMissingColumns=True)
    inside = F.last("_step", ignorenulls=True).over(Window.partitionBy(key, "_bin").orderBy("_pos", "_real"))
    found = both.withColumn("_found", inside).where("_real = 1").drop("_step").join(carry, [key, "_bin"], "left").withColumn("_found", F.coalesce("_found", "_carry"))
    return found.select(*points.columns, *(F.col(f"_found.{c}").alias(c) for c in keep))


def lift(points: DataFrame, events: DataFrame, back: bool, point: str = "pos", ends: bool = False) -> DataFrame:
    """Add ``lifted``: positions of the shortened sequence in the original one, or with ``back`` the
    other way. At a removal a position lies to its right, with ``ends`` (half-open ends) to its left.
    Positions inside a removed stretch go back to where it was cut out. ``points`` has ``entity``."""
    shifts = with_shifts(events)
    if back:
        shifts = shifts.withColumn("from", F.col("orig_start") + F.col("unit_len") + (1 if ends else 0))
        near = _last_before(points, shifts, "entity", point, "from", ["at", "shift", "removed", "orig_end"])
        inside = F.col(point) < F.col("orig_end")
        return near.withColumn("lifted", F.when(F.col("at").isNull(), F.col(point)).when(inside, F.col("at")).otherwise(F.col(point) - F.col("shift") - F.col("removed"))).select(*points.columns, "lifted")
    shifts = shifts.withColumn("from", F.col("at") + (1 if ends else 0)).groupBy("entity", "from").agg(F.max(F.col("shift") + F.col("removed")).alias("by"))
    near = _last_before(points, shifts, "entity", point, "from", ["by"])
    return near.withColumn("lifted", F.col(point) + F.coalesce("by", F.lit(0))).select(*points.columns, "lifted")


def lift_through(points: DataFrame, layers: list[DataFrame], point: str = "pos") -> DataFrame:
    """Lift positions through maps made one after another, the newest first."""
    for events in reversed(layers):
        points = lift(points, events, back=False, point=point).withColumn(point, F.col("lifted")).drop("lifted")
    return points.withColumn("lifted", F.col(point))


def map_info(events: DataFrame, lengths: DataFrame) -> DataFrame:
    """``entity``, ``orig_len``, ``short_len``, ``n_events`` of each sequence of known length."""
    taken = with_shifts(events).groupBy("entity").agg(F.sum("removed").alias("taken"), F.count(F.lit(1)).alias("n_events"))
    all_ = lengths.where("len is not null").join(taken, "entity", "left")
    return all_.select("entity", F.col("len").alias("orig_len"), (F.col("len") - F.coalesce("taken", F.lit(0))).alias("short_len"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def collapse_sequences(sequences: DataFrame, events: DataFrame) -> DataFrame:
    """``entity``, ``seq``: each sequence without the removed stretches. ``sequences`` has ``entity`` and
    ``seq``. The pieces of one sequence meet in one row, as the sequence itself does."""
    lengths = sequences.select("entity", F.length("seq").cast("long").alias("len"))
    merged = with_shifts(events).select("entity", (F.col("orig_start") + F.col("unit_len")).alias("orig_start"), "orig_end").where("orig_start < orig_end")
    parts = kept_segments(merged, lengths).groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("seg_start", "seg_end"))).alias("kept"))
    text = F.array_join(F.transform("kept", lambda k: F.substring("seq", (k["seg_start"] + 1).cast("int"), (k["seg_end"] - k["seg_start"]).cast("int"))), "")
    return sequences.join(parts, "entity", "left").select("entity", F.coalesce(text, F.substring("seq", 1, 0)).alias("seq"))


def mask_sequences(sequences: DataFrame, events: DataFrame, soft: bool = False) -> DataFrame:
    """``entity``, ``seq``: the sequences with the events' bases as N, or in lower case if ``soft``, the others in
    upper case. Events beyond the end of a sequence are cut."""
    n = F.length("seq").cast("long")
    merged = merge_events(events, "entity", "orig_start", "orig_end", "unit_len")
    inside = merged.join(sequences.select("entity", n.alias("n")), "entity").where("orig_start < n").select("entity", "orig_start", F.least("orig_end", "n").alias("orig_end"))
    cut = inside.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("orig_start", "orig_end"))).alias("cuts"))
    begin, end = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts.orig_end")), F.concat(F.col("cuts.orig_start"), F.array(n))
    piece = lambda a, b: F.substring("seq", (a + 1).cast("int"), (b - a).cast("int"))
    kept = F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda x: F.upper(piece(x["b"], x["e"])))
    masked = F.transform("cuts", lambda x: F.lower(piece(x["orig_start"], x["orig_end"])) if soft else F.repeat(F.lit("N"), (x["orig_end"] - x["orig_start"]).cast("int")))
    parts = F.zip_with(kept, F.concat(masked, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return sequences.join(cut, "entity", "left").select("entity", F.when(F.col("cuts").isNull(), F.upper("seq")).otherwise(F.array_join(parts, "")).alias("seq"))


def removed_pieces(sequences: DataFrame, events: DataFrame) -> DataFrame:
    """Merged events with the bases they take out, from which :func:`reconstruct` restores."""
    shifts = with_shifts(events).join(sequences, "entity")
    return shifts.select("entity", "orig_start", "orig_end", "unit_len", "shift", "at", F.substring("seq", (F.col("orig_start") + F.col("unit_len") + 1).cast("int"), F.col("removed").cast("int")).alias("removed_seq"))


def reconstruct(collapsed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``entity``, ``seq``: the original sequences from the collapsed ones and the removed pieces."""
    cut = pieces.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("at", "orig_start", "removed_seq"))).alias("cuts"))
    begin = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts.at"))
    end = F.concat(F.col("cuts.at"), F.array(F.length("seq").cast("long")))
    kept = F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda x: F.substring("seq", (x["b"] + 1).cast("int"), (x["e"] - x["b"]).cast("int")))
    parts = F.zip_with(kept, F.concat("cuts.removed_seq", F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return collapsed.join(cut, "entity", "left").select("entity", F.when(F.col("cuts").isNull(), F.col("seq")).otherwise(F.array_join(parts, "")).alias("seq"))


def chain(first: DataFrame, second: DataFrame) -> DataFrame:
    """One map that does what ``first`` and then ``second`` do: the events of the second in original
    coordinates, and those of the first that do not lie inside one of them."""
    starts = lift(second.withColumn("pos", F.col("orig_start") + F.col("unit_len")), first, back=False)
    lifted = lift(starts.withColumn("s", F.col("lifted")).drop("lifted").withColumn("pos", F.col("orig_end")), first, back=False, ends=True)
    ours = lifted.select("entity", F.col("s").alias("orig_start"), F.col("lifted").alias("orig_end"), F.lit(0).cast("long").alias("unit_len"))
    theirs = first.select("entity", (F.col("orig_start") + F.col("unit_len")).alias("orig_start"), "orig_end", F.lit(0).cast("long").alias("unit_len"))
    return merge_events(ours.unionByName(theirs), "entity", "orig_start", "orig_end", "unit_len")


def overlapping(left: DataFrame, right: DataFrame, key: str, s: str, e: str, other_s: str, other_e: str, width: int = BIN) -> DataFrame:
    """Left semi join by range: the rows of ``left`` whose interval overlaps one of ``right`` with the same
    key. Intervals are entered in the bins they touch and joined on (key, bin). ``left`` keeps its
    columns; rows with nulls and empty intervals overlap nothing."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    r = right.where(F.col(other_s) < F.col(other_e)).select(F.col(key).alias("_key"), F.col(other_s).alias("_s"), F.col(other_e).alias("_e")).withColumn("_bin", bins("_s", "_e"))
    numbered = left.withColumn("_id", F.monotonically_increasing_id())
    numbered = keep_partitions(numbered)
    l = numbered.where(F.col(s) < F.col(e)).select("_id", F.col(key).alias("_k"), F.col(s).alias("_a"), F.col(e).alias("_b")).withColumn("_lbin", bins("_a", "_b"))
    hit = l.join(r, (F.col("_k") == F.col("_key")) & (F.col("_lbin") == F.col("_bin")) & (F.col("_a") < F.col("_e")) & (F.col("_s") < F.col("_b")), "left_semi")
    return numbered.join(hit.select("_id").distinct(), "_id", "left_semi").drop("_id")


def tandem_bed(alignments: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """``name``, ``start``, ``end``: the stretch that each alignment (``seq_index``, ``s1``, ``e1``, ``s2``, ``e2``) of a sequence
    with itself covers, under the sequence's name. Empty ones, those with nulls or of unknown sequences have none."""
    span = alignments.select("seq_index", F.least("s1", "s2").alias("start"), F.greatest("e1", "e2").alias("end")).where("start < end")
    return span.join(scaffolds.select("seq_index", "name"), "seq_index").where("name is not null").select("name", "start", "end")


def large_indels(blocks: DataFrame, a: str, b: str, least: int = 50, width: int = BIN) -> DataFrame:
    """``a``, ``b``, ``kind``, ``start``, ``end``, ``n_bases``: where one of two aligned sequences has ``least`` bases or more that the other lacks.

    ``blocks`` has columns ``a``, ``b``, ``sa``, ``ea``, ``sb``, ``eb``. Each block is met with the last one of its pair that begins before it in
    ``a``; of several that begin at one place the greatest (``sb``, ``ea``, ``eb``) counts. If the second begins later in ``b`` too, the
    difference of the gaps is an insertion in ``a`` (kind 'a') or in ``b``, which lies between the blocks there. Blocks
    with nulls are left out. The blocks of one pair are met in bins, so a pair of any size is many tasks."""
    some = blocks.dropna(subset=[a, b, "sa", "ea", "sb", "eb"]).groupBy(F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("pair"), "sa").agg(F.max(F.struct("sb", "ea", "eb")).alias("x")).select("pair", "sa", "x.*")
    steps = some.select("pair", F.col("sa").alias("at"), F.col("sb").alias("psb"), F.col("ea").alias("pea"), F.col("eb").alias("peb"))
    near = _last_before(some.withColumn("point", F.col("sa") - 1), steps, "pair", "point", "at", ["psb", "pea", "peb"], width).where("sb > psb")
    more = (F.col("sa") - F.col("pea")) - (F.col("sb") - F.col("peb"))
    near = near.withColumn("more", more).where(F.abs("more") >= least)
    first = F.col("more") > 0
    return near.select("pair.a", "pair.b", F.when(first, "a").otherwise("b").alias("kind"), F.when(first, F.col("pea")).otherwise(F.col("peb")).alias("start"), F.when(first, F.col("sa")).otherwise(F.col("sb")).alias("end"), F.abs("more").alias("n_bases"))
