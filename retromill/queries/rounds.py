"""Queries on the round loop: reconciling, collapsing, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from retromill.operators import coordinates as co
from retromill.operators.classes import is_ltr
from retromill.operators.periods import periods_and_gaps
from retromill.queries.classes import CLASSED, consensus_class
from retromill.queries.intervals import ALIGNS, ELEMENTS, alignments, elements
from retromill.queries.registry import query
from retromill.queries.sequences import records
from retromill.operators.periods import merge_events
from retromill.plans.rounds import original_positions, reconcile, reconcile_nodes, round_bed, round_stats, run_rounds, scan_stats, to_collapse
from retromill.shared import materialize, table


@query(f"with {ELEMENTS} select seq_index, r1s as start, r2e as \"end\", name from e")
def detection_bed(spark, d):
    return elements(spark, d).select(F.col("scaffold_idx").cast("long").alias("seq_index"), F.col("r1s").alias("start"), F.col("r2e").alias("end"), "name")


@query(f"with {ELEMENTS} select seq_index, fl_s as start, fr_e as \"end\", name from e")
def flank_bed(spark, d):
    return elements(spark, d).select(F.col("scaffold_idx").cast("long").alias("seq_index"), F.col("fl_s").alias("start"), F.col("fr_e").alias("end"), "name")


@query("with {records} select regexp_replace(name, '\\s.*', '') || '_' || regexp_replace(split_part(coalesce(genome, 'none'), '.', 1), '[-_.]', '', 'g') as name, length(full_seq) as len from r")
def union_genomes(spark, d):
    """All elements under names that carry the label of their genome."""
    label = F.regexp_replace(F.substring_index(F.coalesce("genome", F.lit("none")), ".", 1), "[-_.]", "")
    return records(spark, d, "full_seq", plain=("genome",)).select(F.concat(F.regexp_replace("name", r"\s.*", ""), F.lit("_"), label).alias("name"), F.length("full_seq").cast("long").alias("len"))


@query(f"with {ALIGNS} select cast(scaffold_idx as bigint) as seq_index, r1s as start, r2e as \"end\", 'r' || round || '_' || aln_id as name, round from x where round is not null")
def combined_bed(spark, d):
    """Detections of all rounds under names with their round."""
    a = alignments(spark, d).where("round is not null")
    return round_bed(a.select("scaffold_idx", "r1s", "r2e", F.col("aln_id").cast("string").alias("element"), "round"))


@query(f"with {ALIGNS} select distinct s.name from x join scaffolds s on s.seq_index = x.scaffold_idx where round = 1")
def active_scaffolds(spark, d):
    """Scaffolds to scan again: those with something to take out."""
    a = alignments(spark, d).where("round = 1").select(F.col("scaffold_idx").alias("seq_index")).distinct()
    return table(spark, d, "scaffolds").join(a, "seq_index", "left_semi").select("name").distinct()


@query(f"""with {ALIGNS}, o as (select *, row_number() over (partition by scaffold_idx, r1s, r2e, r1e order by aln_id) as k from x where round = 1), w as (select *, row_number() over (partition by scaffold_idx, r1s, r2e, r1e order by aln_id) as k from x where round > 1)
select w.aln_id, o.aln_id as reused from w left join o on w.scaffold_idx = o.scaffold_idx and w.r1s = o.r1s and w.r2e = o.r2e and w.r1e is not distinct from o.r1e and w.k = o.k""")
def reconciled_nodes(spark, d):
    """Later detections and the node of the first round that each takes over, one to one."""
    a = alignments(spark, d).withColumn("key", F.struct("scaffold_idx", "r1s", "r2e", "r1e"))
    found = reconcile(a.where("round > 1").select("key", F.col("aln_id").alias("id")), a.where("round = 1").select("key", F.col("aln_id").alias("id")))
    return found.select(F.col("id").alias("aln_id"), "reused")


@query(f"""with {ALIGNS}, i as (select round, cast(scaffold_idx as bigint) * 1000000000000 + r1s as s, cast(scaffold_idx as bigint) * 1000000000000 + r2e as e from x where round is not null and scaffold_idx in (select seq_index from scaffolds)),
b as (select *, max(e) over (partition by round order by s, e rows between unbounded preceding and 1 preceding) as before from i), u as (select round, count(*) as n_elements, cast(sum(greatest(0, e - greatest(s, coalesce(before, s)))) as bigint) as covered from b group by round),
t as (select cast(sum(scaf_len) as bigint) as total from scaffolds)
select round, n_elements, covered, cast(round_even(10000 * covered / total, 0) as bigint) as permyriad from u, t""")
def round_report(spark, d):
    """Elements and covered bases of each round, and their share of all scaffolds."""
    a = alignments(spark, d).where("round is not null").join(table(spark, d, "scaffolds").select(F.col("seq_index").alias("scaffold_idx")), "scaffold_idx", "left_semi")
    placed = a.select("round", (F.col("round").cast("long") * 2**32 + F.col("scaffold_idx")).alias("entity"), "r1s", "r2e")
    return round_stats(placed, table(spark, d, "scaffolds"))


@query(f"""with {ALIGNS}, i as (select round, cast(scaffold_idx as bigint) as entity, r1s as s, r2e as e, greatest(r1e - r1s, 0) as unit from x where round is not null and r1e is not null and scaffold_idx in (select seq_index from scaffolds)),
b as (select *, max(e) over (partition by round, entity order by s, e, unit rows between unbounded preceding and 1 preceding) as before from i),
g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by round, entity order by s, e, unit rows unbounded preceding) as island from b),
m as (select round, entity, min(s) as s, max(e) as e, case when count(*) = 1 then least(max(unit), max(e) - min(s)) else 0 end as unit from g group by round, entity, island),
w as (select round, entity, greatest(s - 32768, 0) as s, least(e + 32768, scaf_len) as e from i join scaffolds on seq_index = entity where scaf_len is not null),
wb as (select *, max(e) over (partition by round, entity order by s, e rows between unbounded preceding and 1 preceding) as before from w where s < e),
win as (select round, cast(sum(greatest(0, e - greatest(s, coalesce(before, s)))) as bigint) as active from wb group by round),
t as (select cast(sum(scaf_len) as bigint) as total from scaffolds),
k as (select round, (select count(*) from i where i.round = m.round) as n_events, cast(sum(e - s - unit) as bigint) as removed from m group by round),
o as (select k.*, total, total - cast(sum(removed) over (order by round) as bigint) as after, lag(coalesce(active, 0)) over (order by round) as prev, row_number() over (order by round) as nth from k left join win using (round), t),
r as (select *, after + removed as before, case when nth = 1 then total else prev end as active_bp from o)
select round, n_events, removed, before, after, cast(round_even(10000 * removed / before, 0) as bigint) as round_permyriad, cast(round_even(10000 * (total - after) / total, 0) as bigint) as total_permyriad, active_bp, total - active_bp as skipped_bp from r""")
def scan_report(spark, d):
    """What each round of detections takes out, and how much is scanned again after it."""
    a = alignments(spark, d).where("round is not null and r1e is not null").join(table(spark, d, "scaffolds").select(F.col("seq_index").alias("scaffold_idx")), "scaffold_idx", "left_semi")
    placed = a.select("round", (F.col("round").cast("long") * 2**32 + F.col("scaffold_idx")).alias("entity"), F.col("r1s").alias("orig_start"), F.col("r2e").alias("orig_end"), F.greatest(F.col("r1e") - F.col("r1s"), F.lit(0)).alias("unit_len"))
    return scan_stats(placed, table(spark, d, "scaffolds"))


@query(f"""with {ALIGNS}, c as (select scaffold_idx, round, count(*) as n, cast(sum(r2e - r1s) as bigint) as total, max(r2e - r1s) as longest from x where round is not null group by scaffold_idx, round)
select 'A' as line, cast(scaffold_idx as bigint) as grp, cast(sum(n) as bigint) as n, cast(sum(total) as bigint) as total, max(longest) as longest from c group by scaffold_idx""")
def line_counts(spark, d):
    """Number, total and longest of the alignment lines of each scaffold, as a file header has them."""
    a = alignments(spark, d).where("round is not null").withColumn("len", F.col("r2e") - F.col("r1s"))
    return a.groupBy(F.col("scaffold_idx").cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), F.max("len").alias("longest")).select(F.lit("A").alias("line"), "grp", "n", "total", "longest")


#: detections as members of consensi in turn, by their number, and the class of each consensus by the votes of hits
NUMBERED = f"""{CLASSED}, names as (select name, row_number() over (order by name) - 1 as k from (select distinct name from consensi where name is not null)),
ltr as (select k from names join cc on family = name where regexp_matches(regexp_replace(trim(cls), '[?]+$', ''), '(?i)^LTR(/|$)'))"""
TAKEN = f"{ALIGNS}, {NUMBERED}, taken as (select aln_id, cast(scaffold_idx as bigint) as entity, r1s as orig_start, r2e as orig_end from x where round = 1 and aln_id % (select count(*) from names) in (select k from ltr))"


def taken(spark, d):
    names = co.number_rows(table(spark, d, "consensi").where("name is not null").select("name").distinct(), "name", name="k").withColumn("k", F.col("k") - 1)
    names, facts = materialize(names, F.count(F.lit(1)).alias("n"))
    first = alignments(spark, d).where("round = 1").select(F.col("aln_id").alias("member"), F.col("scaffold_idx").cast("long").alias("entity"), F.col("r1s").alias("start"), F.col("r2e").alias("end"))
    members = first.select("member", (F.col("member") % max(1, facts["n"])).alias("k")).join(names, "k").select(F.col("name").alias("consensus"), "member")
    return to_collapse(members, consensus_class(spark, d), first)


@query(f"with {TAKEN} select * from taken")
def intervals_to_collapse(spark, d):
    """What the first round takes out: its detections in families that are classified as LTR."""
    return taken(spark, d).withColumnRenamed("member", "aln_id")


@query(f"""with {TAKEN}, q as (select x.*, coalesce(upper(s.seq), '') as seq from x left join (select k, min(upper(seq)) as seq from names join consensi using (name) group by k) s on s.k = x.aln_id % 4),
h as (select distinct x.aln_id from x join taken t on t.entity = x.scaffold_idx and greatest(x.r1s - 100, 0) < t.orig_end and t.orig_start < x.r2e + 100 where round > 1),
o as (select *, row_number() over (partition by scaffold_idx, r1s, r2e, seq order by aln_id) as n from q where round = 1), w as (select *, row_number() over (partition by scaffold_idx, r1s, r2e, seq order by aln_id) as n from q where round > 1 and aln_id not in (select aln_id from h))
select w.aln_id, o.aln_id as reused from w left join o on w.scaffold_idx = o.scaffold_idx and w.r1s = o.r1s and w.r2e = o.r2e and w.seq = o.seq and w.n = o.n union all select aln_id, null from h""")
def reused_nodes(spark, d):
    """Later detections and the nodes of the first round that they take over: same place, same sequence (that of one of
    four consensi, by number), and not beside anything that was taken out."""
    c = co.number_rows(table(spark, d, "consensi").where("name is not null").select("name").distinct(), "name", name="k")
    seqs = table(spark, d, "consensi").join(c, "name").where("k <= 4").groupBy((F.col("k") - 1).alias("k")).agg(F.min(F.upper("seq")).alias("seq"))
    a = alignments(spark, d).withColumn("k", F.col("aln_id") % 4).join(F.broadcast(seqs), "k", "left")
    a, _ = materialize(a.select(F.col("aln_id").alias("id"), "round", F.col("scaffold_idx").cast("long").alias("entity"), F.col("r1s").alias("start"), F.col("r2e").alias("end"), "seq", F.greatest(F.col("r1s") - 100, F.lit(0)).alias("fs"), (F.col("r2e") + 100).alias("fe")))
    return reconcile_nodes(a.where("round > 1"), a.where("round = 1"), taken(spark, d)).withColumnRenamed("id", "aln_id")


@query()
def round_loop(spark, d):
    """The loop over all rounds of detections: nodes of one consensus are linked, families classified as LTR are taken
    out after each round, and what the last round found comes out in the coordinates of the original sequences."""
    names = co.number_rows(table(spark, d, "consensi").where("name is not null").select("name").distinct(), "name", name="k").withColumn("k", F.col("k") - 1)
    names, facts = materialize(names, F.count(F.lit(1)).alias("n"))
    of = (F.col("aln_id") % max(1, facts["n"])).alias("k")
    a, seen = materialize(alignments(spark, d).where("round >= 1").select("aln_id", of, F.col("scaffold_idx").cast("long").alias("entity"), F.col("r1s").alias("start"), F.col("r2e").alias("end"), "round"), F.max("round").alias("most"))
    ltr = consensus_class(spark, d).where(is_ltr(F.col("class"))).join(names.withColumnRenamed("name", "consensus"), "consensus").select("k").distinct()
    ltr, _ = materialize(ltr)
    number = lambda c: F.substring_index(c, "_", -1).cast("long").alias("aln_id")

    def detect(layers, k):
        return a.where(F.col("round") == k).select(F.col("aln_id").cast("string").alias("name"), "entity", "start", "end")

    def link(nodes):
        placed = nodes.select("name", number("name")).select("name", of)
        return placed.join(placed.groupBy("k").agg(F.min("name").alias("first")), "k").where("first <> name").select(F.col("first").alias("a"), F.col("name").alias("b"))

    def keep(families):
        return families.select("family", "member", number("member")).select("family", "member", of).join(ltr, "k", "left_semi")

    most = seen["most"] or 1
    _, layers = run_rounds(detect, link, keep, most)
    last = a.where(F.col("round") == len(layers) + 1).select("aln_id", "entity", "start", "end")
    return original_positions(last, layers)
