"""Queries on intervals and coordinate maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from retromill.operators import coordinates as co
from retromill.operators.periods import merge_events
from retromill.queries.registry import query
from retromill.queries.sequences import records
from retromill.shared import materialize, table

#: one row for each alignment, by the number of its detection round
ALIGNS = """a as (select * from (select aln_id, scaffold_idx, r1s, r1e, r2s, r2e, round, row_number() over (partition by aln_id order by loaded_at desc) as copy from ltr_aligns where aln_id is not null) where copy = 1),
x as (select * from a where scaffold_idx is not null and r1s < r2e),
ev as (select distinct cast(scaffold_idx as bigint) as entity, r1s as s, r2e as e, r1e - r1s as unit from x where round = 1)"""
#: the removed intervals of the first round, merged; unit kept where nothing was merged
MERGED = """i as (select entity, r1s as s, r2e as e, greatest(r1e - r1s, 0) as unit from (select cast(scaffold_idx as bigint) as entity, r1s, r1e, r2e from x where round = 1 and r1e is not null)),
b as (select *, max(e) over (partition by entity order by s, e, unit rows between unbounded preceding and 1 preceding) as before from i),
g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by entity order by s, e, unit rows unbounded preceding) as island from b),
m as (select entity, min(s) as orig_start, max(e) as orig_end, case when count(*) = 1 then least(max(unit), max(e) - min(s)) else 0 end as unit_len from g group by entity, island)"""
#: the same with what each takes out and what was taken out before it
SHIFTS = """sh as (select *, orig_end - orig_start - unit_len as removed, cast(coalesce(sum(orig_end - orig_start - unit_len) over (partition by entity order by orig_start rows between unbounded preceding and 1 preceding), 0) as bigint) as shift from m)"""


def alignments(spark, d):
    a = table(spark, d, "ltr_aligns").where("aln_id is not null")
    return a.groupBy("aln_id").agg(F.max(F.struct("loaded_at", "scaffold_idx", "r1s", "r1e", "r2s", "r2e", "round")).alias("x")).select("aln_id", "x.*").where("scaffold_idx is not null and r1s < r2e")


def first_events(spark, d):
    a = alignments(spark, d).where("round = 1 and r1e is not null")
    return a.select(F.col("scaffold_idx").cast("long").alias("entity"), F.col("r1s").alias("orig_start"), F.col("r2e").alias("orig_end"), F.greatest(F.col("r1e") - F.col("r1s"), F.lit(0)).alias("unit_len"))


def removed(spark, d):
    return merge_events(first_events(spark, d), "entity", "orig_start", "orig_end", "unit_len").withColumn("unit_len", F.least("unit_len", F.col("orig_end") - F.col("orig_start")))


def lengths(spark, d):
    return table(spark, d, "scaffolds").select(F.col("seq_index").cast("long").alias("entity"), F.col("scaf_len").alias("len"))


def points(spark, d, column):
    return alignments(spark, d).where(F.col(column).isNotNull()).select("aln_id", F.col("scaffold_idx").cast("long").alias("entity"), F.col(column).alias("pos"))


@query(f"with {ALIGNS}, {MERGED} select entity, orig_start, orig_end, unit_len from m")
def collapse_spec(spark, d):
    """The collapse table: first-round elements, merged; a merged one keeps no unit."""
    return removed(spark, d)


@query(f"""with {ALIGNS}, {MERGED}, w as (select entity, greatest(orig_start - 32768, 0) as s, least(orig_end + 32768, scaf_len) as e from m join scaffolds on seq_index = entity where scaf_len is not null),
wb as (select *, max(e) over (partition by entity order by s, e rows between unbounded preceding and 1 preceding) as before from w where s < e),
wg as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by entity order by s, e rows unbounded preceding) as island from wb)
select entity, min(s) as win_start, max(e) as win_end from wg group by entity, island""")
def scan_windows(spark, d):
    return co.scan_windows(removed(spark, d), lengths(spark, d))


@query(f"""with {ALIGNS}, {MERGED}, c as (select entity, orig_start, least(orig_end, scaf_len) as orig_end, scaf_len from m join scaffolds on seq_index = entity where scaf_len is not null and orig_start < scaf_len),
e as (select entity, orig_start as a, orig_end as z from c union all select cast(seq_index as bigint), scaf_len, scaf_len from scaffolds where scaf_len is not null),
k as (select entity, coalesce(lag(z) over (partition by entity order by a, z), 0) as seg_start, a as seg_end from e)
select entity, seg_start, seg_end from k where seg_start < seg_end""")
def kept_segments(spark, d):
    return co.kept_segments(removed(spark, d), lengths(spark, d))


@query(f"""with {ALIGNS}, {MERGED}, {SHIFTS} select entity, orig_start, orig_end, unit_len, removed, shift, orig_start + unit_len - shift as "at" from sh""")
def cumulative_shifts(spark, d):
    return co.with_shifts(removed(spark, d))


@query(f"""with {ALIGNS}, {MERGED}, {SHIFTS}, p as (select aln_id, cast(scaffold_idx as bigint) as entity, r1s as pos from x)
select p.aln_id, p.entity, p.pos, case when orig_start is null then pos when pos < orig_end then orig_start + unit_len - shift else pos - shift - removed end as lifted
from p asof left join (select *, orig_start + unit_len as f from sh) t on p.entity = t.entity and p.pos >= t.f""")
def lift_shortened(spark, d):
    """Starts of all elements in the sequence from which the first round's elements were taken."""
    return co.lift(points(spark, d, "r1s"), removed(spark, d), back=True)


@query(f"""with {ALIGNS}, {MERGED}, {SHIFTS}, p as (select aln_id, cast(scaffold_idx as bigint) as entity, r2e as pos from x),
f as (select entity, orig_start + unit_len - shift as f, max(shift + removed) as moved from sh group by 1, 2)
select p.aln_id, p.entity, p.pos, pos + coalesce(moved, 0) as lifted from p asof left join f on p.entity = f.entity and p.pos >= f.f""")
def lift_original(spark, d):
    """Ends of all elements, read as positions of the shortened sequence, in the original one."""
    return co.lift(points(spark, d, "r2e"), removed(spark, d), back=False)


@query(f"""with {ALIGNS}, {MERGED}, {SHIFTS}, f as (select entity, orig_start + unit_len - shift as f, max(shift + removed) as moved from sh group by 1, 2),
p as (select aln_id, cast(scaffold_idx as bigint) as entity, r1s as pos from x),
q as (select p.aln_id, p.entity, p.pos, pos + coalesce(moved, 0) as once from p asof left join f on p.entity = f.entity and p.pos >= f.f)
select q.aln_id, q.entity, once + coalesce(moved, 0) as lifted from q asof left join f on q.entity = f.entity and q.once >= f.f""")
def lift_through_layers(spark, d):
    """Positions lifted through two layers of maps, the newest first."""
    layer = removed(spark, d)
    return co.lift_through(points(spark, d, "r1s"), [layer, layer]).select("aln_id", "entity", "lifted")


@query()
def lift_through_rounds(spark, d):
    """Starts of all elements in the original sequences: those of a round are read as positions of the sequences that the
    rounds before it left, and lifted through the maps of these rounds, one map for each round, the newest first."""
    a = alignments(spark, d).where("round >= 1")
    most = a.agg(F.max("round").alias("most")).first()["most"] or 1
    entity = F.col("scaffold_idx").cast("long").alias("entity")
    found = a.where("r1s is not null").select("aln_id", entity, "round", F.col("r1s").alias("pos"))
    for k in range(most - 1, 0, -1):
        out = a.where((F.col("round") == k) & F.col("r1e").isNotNull()).select(entity, F.col("r1s").alias("s"), F.col("r2e").alias("e"), F.greatest(F.col("r1e") - F.col("r1s"), F.lit(0)).alias("unit"))
        layer = merge_events(out, "entity", "s", "e", "unit").select("entity", F.col("orig_start"), F.col("orig_end"), F.least("unit_len", F.col("orig_end") - F.col("orig_start")).alias("unit_len"))
        lifted = co.lift_through(found.where(F.col("round") > k), [layer]).select("aln_id", "entity", "round", F.col("lifted").alias("pos"))
        found = found.where(F.col("round") <= k).unionByName(lifted)
    return found.select("aln_id", "entity", "round", F.col("pos").alias("lifted"))


@query(f"""with {ALIGNS}, {MERGED}, {SHIFTS}, t as (select entity, sum(removed) as taken, count(*) as n from sh group by entity)
select cast(seq_index as bigint) as entity, scaf_len as orig_len, cast(scaf_len - coalesce(taken, 0) as bigint) as short_len, coalesce(n, 0) as n_events from scaffolds left join t on entity = seq_index where scaf_len is not null""")
def map_info(spark, d):
    return co.map_info(removed(spark, d), lengths(spark, d))


@query(f"""with {ALIGNS}, {MERGED} select aln_id from x where round > 1 and exists (select 1 from m where m.entity = x.scaffold_idx and greatest(x.r1s - 100, 0) < m.orig_end and m.orig_start < x.r2e + 100)""")
def affected_by_removal(spark, d):
    """Later elements whose footprint, flanks included, overlaps what the first round removed."""
    later = alignments(spark, d).where("round > 1").select("aln_id", F.col("scaffold_idx").cast("long").alias("entity"), F.greatest(F.col("r1s") - 100, F.lit(0)).alias("fs"), (F.col("r2e") + 100).alias("fe"))
    return co.overlapping(later, removed(spark, d), "entity", "fs", "fe", "orig_start", "orig_end").select("aln_id")


@query("""select cast(seq_index as bigint) as seq_index, genome, scaf_len, cast(sum(coalesce(scaf_len, 0)) over (partition by genome order by seq_index) - coalesce(scaf_len, 0) as bigint) as "offset" from scaffolds""")
def contig_offsets(spark, d):
    """Where each scaffold begins when those of a genome are laid end to end."""
    s = table(spark, d, "scaffolds").select(F.col("seq_index").cast("long").alias("ord"), F.col("genome").alias("scaffold"), F.col("scaf_len").alias("len"))
    found = co.contig_offsets(s.withColumn("raw", F.col("len")))
    return found.select(F.col("ord").alias("seq_index"), F.col("scaffold").alias("genome"), F.col("raw").alias("scaf_len"), "offset")


ELEMENTS = """a as (select * from (select *, row_number() over (partition by aln_id order by loaded_at desc) as copy from ltr_aligns where aln_id is not null) where copy = 1),
e as (select 'LTR_' || cast(row_number() over (order by scaffold_idx, r1s, r2s, aln_id) as varchar) as name, s.name as scaffold, cast(scaffold_idx as bigint) as seq_index, aln_id, greatest(r1s - 100, 0) as fl_s, r1s, r1e, r2s, r2e, least(r2e + 100, scaf_len) as fr_e
from a join scaffolds s on s.seq_index = a.scaffold_idx where r1e - r1s <> 0 and r2e - r2s <> 0 and r1s is not null and r2e <= scaf_len)"""


def elements(spark, d):
    return co.extract_elements(table(spark, d, "ltr_aligns"), table(spark, d, "scaffolds"))


@query(f"""with {ELEMENTS} select name, '>' || name || ' scaffold=' || scaffold || ' flank_l=' || fl_s || '-' || r1s || ' repeat1=' || r1s || '-' || r1e || ' repeat2=' || r2s || '-' || r2e || ' flank_r=' || r2e || '-' || fr_e as header from e""")
def element_headers(spark, d):
    """The description lines of all extracted elements, numbered in their order."""
    return co.element_header(elements(spark, d))


@query(f"""with {ELEMENTS} select cast(count(*) as bigint) as n_alignments, (select cast(sum(scaf_len) as bigint) from scaffolds) as total_bp, (select cast(sum(scaf_len) as bigint) from scaffolds where seq_index in (select seq_index from e)) as active_bp,
count(distinct seq_index) as n_active, (select cast(sum(scaf_len) as bigint) from scaffolds where name in (select scaffold from e where r1s < 100000)) as restricted_bp from e""")
def alignment_summary(spark, d):
    """Alignments, bases of all scaffolds, of those with alignments, and of a list of names."""
    e, s = elements(spark, d), table(spark, d, "scaffolds")
    on = e.groupBy(F.col("scaffold").alias("name"), "scaffold_idx").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("r1s") < 100000).cast("int")).alias("listed"))
    both = s.join(on.select(F.col("scaffold_idx").alias("seq_index"), "n", "listed"), "seq_index", "left")
    bp = lambda c: F.sum(F.when(c, F.col("scaf_len"))).alias
    return both.agg(F.sum("n").alias("n_alignments"), F.sum("scaf_len").alias("total_bp"), bp(F.col("n").isNotNull())("active_bp"), F.count("n").alias("n_active"), bp(F.col("listed") == 1)("restricted_bp"))


@query("""with w as (select distinct case when seq_index % 3 = 0 then name || ' ' || coalesce(descr, '') when seq_index % 3 = 1 then name else name || ' gone' end as scaffold from scaffolds),
f as (select name || ' ' || descr as scaffold, min(seq_index) as a from scaffolds where descr <> '' group by 1), n as (select name as scaffold, min(seq_index) as b from scaffolds group by 1)
select scaffold, coalesce(a, b) as seq_index from w left join f using (scaffold) left join n using (scaffold)""")
def resolved_scaffolds(spark, d):
    """Names as alignments give them, with and without descriptions, and the scaffolds they mean."""
    s = table(spark, d, "scaffolds")
    name = F.when(F.col("seq_index") % 3 == 0, F.concat("name", F.lit(" "), F.coalesce("descr", F.lit("")))).when(F.col("seq_index") % 3 == 1, F.col("name")).otherwise(F.concat("name", F.lit(" gone")))
    return co.resolve_scaffolds(s.select(name.alias("scaffold")), s)


@query("""with {records}, g as (select *, sum(length(full_seq)) over (partition by genome order by name) - length(full_seq) as loc from r where genome is not null),
w as (select genome, string_agg(full_seq, '' order by name) as s from g group by genome),
p as (select name, genome, greatest(loc + length(flank_l) - 100, 0) as a, loc + length(full_seq) - length(flank_r) + 100 as b from g)
select name, case when a < b then substr(s, cast(a as bigint) + 1, cast(b - a as bigint)) else '' end as seq from p join w using (genome)""")
def extracted_sequences(spark, d):
    """Elements cut out of the sequences of their genomes, the records of a genome end to end, with up to 100 bases to
    each side. A genome lies in pieces, which the stretches cross."""
    r = records(spark, d, "full_seq", "flank_l", "flank_r", plain=("genome",)).where("genome is not null")
    r, _ = materialize(co.number_rows(r, "genome", "name", name="ord"))
    on = co.running_sum(r.withColumn("len", F.length("full_seq").cast("long")), "genome", "ord", "len", "at", 1000)
    wanted = on.select("name", F.col("genome").alias("entity"), F.greatest(F.col("at") + F.length("flank_l") - 100, F.lit(0)).alias("s"), (F.col("at") + F.col("len") - F.length("flank_r") + 100).alias("e"))
    return co.extract_sequences(wanted, on.select(F.col("genome").alias("entity"), F.col("at").alias("start"), F.col("full_seq").alias("seq")))


#: the words of 12 bases at which hits touch their partners, forward ones and others, as events on the partners' sequences
TOUCHED = """el as (select *, row_number() over (order by full_seq, name) - 1 as elem from r),
t1 as (select distinct elem as entity, pj as s, pj + 12 as e from seed_hits join el on name_of = el.name where not is_rc and pj is not null),
t2 as (select distinct elem as entity, pj as s, pj + 12 as e from seed_hits join el on name_of = el.name where is_rc and pj is not null)""".replace("name_of", "partner")


def cut_sql(name: str, seqs: str, events: str) -> str:
    return f"""{name}b as (select *, max(e) over (partition by entity order by s, e rows between unbounded preceding and 1 preceding) as before from {events}),
{name}g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by entity order by s, e rows unbounded preceding) as island from {name}b),
{name}m as (select entity, min(s) as a, max(e) as z from {name}g group by entity, island),
{name}c as (select entity, a, least(z, length(seq)) as z, seq from {name}m join {seqs} using (entity) where a < length(seq) union all select entity, length(seq), length(seq), seq from {seqs}),
{name}k as (select entity, seq, coalesce(lag(z) over (partition by entity order by a, z), 0) as f, a from {name}c),
{name} as (select entity, string_agg(substr(seq, f + 1, a - f), '' order by f, a) as seq from {name}k group by entity)"""


SEQS = "s0 as (select elem as entity, full_seq as seq from el)"


def touched(spark, d):
    from retromill.queries.similarity import elements as numbered

    e, _ = numbered(spark, d)
    h = table(spark, d, "seed_hits").where("pj is not null").join(e.select(F.col("name").alias("partner"), F.col("elem").alias("entity")), "partner")
    events = lambda c: h.where(c).select("entity", F.col("pj").cast("long").alias("orig_start"), (F.col("pj") + 12).cast("long").alias("orig_end"), F.lit(0).cast("long").alias("unit_len")).distinct()
    merged = lambda c: materialize(merge_events(events(c), "entity", "orig_start", "orig_end", "unit_len"))[0]
    return e.select(F.col("elem").alias("entity"), F.col("full_seq").alias("seq")), merged("not is_rc"), merged("is_rc")


@query(f"with {{records}}, {TOUCHED}, {SEQS}, {cut_sql('c1', 's0', 't1')} select entity, seq from c1")
def collapsed_sequences(spark, d):
    """Elements without the words at which forward hits touch them."""
    seqs, first, _ = touched(spark, d)
    return co.collapse_sequences(seqs, first)


@query(f"with {{records}}, {TOUCHED}, {SEQS} select entity, seq from s0")
def reconstructed_sequences(spark, d):
    """The same put together again from what is left and what was taken out."""
    seqs, first, _ = touched(spark, d)
    collapsed, _ = materialize(co.collapse_sequences(seqs, first))
    return co.reconstruct(collapsed, co.removed_pieces(seqs, first))


@query(f"with {{records}}, {TOUCHED}, {SEQS}, {cut_sql('c1', 's0', 't1')}, {cut_sql('c2', 'c1', 't2')} select entity, seq from c2")
def chained_maps(spark, d):
    """Elements collapsed by one map that does what two maps do one after the other."""
    seqs, first, second = touched(spark, d)
    return co.collapse_sequences(seqs, co.chain(first, second))


MASKED = """b as (select *, max(e) over (partition by entity order by s, e rows between unbounded preceding and 1 preceding) as before from t1),
g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by entity order by s, e rows unbounded preceding) as island from b),
m as (select entity, min(s) as a, max(e) as z from g group by entity, island),
c as (select entity, a, least(z, length(seq)) as z, seq from m join s0 using (entity) where a < length(seq) union all select entity, length(seq), length(seq), seq from s0),
k as (select entity, seq, coalesce(lag(z) over (partition by entity order by a, z), 0) as f, a, z from c)"""


@query(f"with {{records}}, {TOUCHED}, {SEQS}, {MASKED} select entity, string_agg(substr(seq, f + 1, a - f) || repeat('N', z - a), '' order by f, a) as seq from k group by entity")
def masked_sequences(spark, d):
    """Elements with the words at which forward hits touch them as N."""
    seqs, first, _ = touched(spark, d)
    return co.mask_sequences(seqs, first)


@query(f"""with {ALIGNS} select s.name, least(r1s, r2s) as start, greatest(r1e, r2e) as "end" from x join scaffolds s on s.seq_index = x.scaffold_idx where r1s is not null and s.name is not null and least(r1s, r2s) < greatest(r1e, r2e)""")
def tandem_bed(spark, d):
    """The stretches that alignments cover, under the names of their scaffolds."""
    a = alignments(spark, d).select(F.col("scaffold_idx").alias("seq_index"), F.col("r1s").alias("s1"), F.col("r1e").alias("e1"), F.col("r2s").alias("s2"), F.col("r2e").alias("e2"))
    return co.tandem_bed(a, table(spark, d, "scaffolds"))


@query("""with h as (select name as a, partner as b, cast(pi as bigint) as sa, max(cast(pj as bigint)) as sb from seed_hits where name is not null and partner is not null and pi is not null and pj is not null and not is_rc group by 1, 2, 3),
n as (select *, lag(sa) over w + 12 as pea, lag(sb) over w + 12 as peb, lag(sb) over w as psb from h window w as (partition by a, b order by sa)),
q as (select *, (sa - pea) - (sb - peb) as more from n where sb > psb)
select a, b, case when more > 0 then 'a' else 'b' end as kind, case when more > 0 then pea else peb end as start, case when more > 0 then sa else sb end as "end", abs(more) as n_bases from q where abs(more) >= 50""")
def large_indels(spark, d):
    """Insertions of 50 bases or more between the words at which elements and their partners meet."""
    h = table(spark, d, "seed_hits").where("not is_rc").select("name", "partner", F.col("pi").cast("long").alias("sa"), (F.col("pi") + 12).cast("long").alias("ea"), F.col("pj").cast("long").alias("sb"), (F.col("pj") + 12).cast("long").alias("eb"))
    return co.large_indels(h, "name", "partner")
