"""Queries that write tables as the pipeline's text files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from retromill.functions import labels
from retromill.operators import classes as cl
from retromill.operators import coordinates as co
from retromill.queries.classes import CLASSED, consensus_class
from retromill.queries.families import HELD, held
from retromill.queries.intervals import ALIGNS, alignments
from retromill.queries.registry import query
from retromill.queries.sequences import records
from retromill.shared import materialize, scratch, table
from retromill.sources import text


@query("with {records} select row_number() over (order by name) - 1 as seq_index, name, 'genome=' || coalesce(genome, 'none') as descr, length(full_seq) as len, md5(full_seq) as digest from r")
def fasta_records(spark, d):
    """Elements written as FASTA in lines of 60 and read back in the order of the file."""
    r = records(spark, d, "full_seq", plain=("genome",))
    path = scratch(spark)
    text.write_fasta(r.select("name", F.concat("name", F.lit(" genome="), F.coalesce("genome", F.lit("none"))).alias("header"), "full_seq"), "header", "full_seq", path, 60, ["name"])
    return text.read_fasta(spark, path).select("seq_index", "name", "descr", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


@query("""with {records} select genome, count(*) as n_seqs, cast(sum(length(full_seq)) as bigint) as total from r where genome is not null group by genome""")
def fasta_sizes(spark, d):
    """Sequences and bases of each genome, counted in its FASTA records."""
    r = records(spark, d, "full_seq", plain=("genome",)).where("genome is not null")
    path = scratch(spark)
    text.write_fasta(r.select(F.concat("name", F.lit(" genome="), "genome").alias("header"), "full_seq"), "header", "full_seq", path)
    f = text.read_fasta(spark, path).withColumn("genome", cl.tag(F.col("descr"), "genome"))
    return f.groupBy("genome").agg(F.count(F.lit(1)).alias("n_seqs"), F.sum(F.length("seq")).alias("total"))


@query(f"with {ALIGNS} select scaffold_idx as seq_index, r1s as start, r2e as \"end\", 'r' || round || '_' || aln_id as element_id, round from x where round is not null")
def bed_records(spark, d):
    """Detections of all rounds written as BED and read back."""
    a = alignments(spark, d).where("round is not null")
    path = scratch(spark)
    name = F.concat(F.lit("r"), F.col("round").cast("string"), F.lit("_"), F.col("aln_id").cast("string"))
    text.write_bed(a.select("scaffold_idx", F.col("r1s").alias("start"), F.col("r2e").alias("end"), name.alias("name"), "round"), path, ["scaffold_idx", "start"])
    return text.read_bed(spark, path)


@query(f"with {HELD} select family as consensus, member from held")
def membership_records(spark, d):
    """Members of consensi as lines of bounded length, written and read back."""
    path = scratch(spark)
    text.write_membership(held(spark, d).withColumnRenamed("family", "consensus"), path)
    return text.read_membership(spark, path).distinct()


@query(f"""with {CLASSED}, m as (select member, max(cls) as cls from held join cc using (family) group by member),
k as (select member, split_part(cls, '/', 1) as o, case when contains(cls, '/') then split_part(cls, '/', 2) else 'unknown' end as sf from m)
select 'rexdb' as db, member as te_id, case when o = 'LTR' and s <> 'unknown' then 'LTR/' || s when o <> 'Unknown' then o || '/unknown' else 'Unknown' end as class_label, 'none' as domains, '?' as strand, 'no' as complete, 'unknown' as clade
from (select *, case sf when 'Pao' then 'Bel-Pao' when 'Retroviridae' then 'Retrovirus' else sf end as s from k)""")
def call_records(spark, d):
    """The classes of elements, as their consensi have them, written as a classifier's table and read back."""
    e = cl.class_of_elements(held(spark, d).withColumnRenamed("family", "consensus"), consensus_class(spark, d)).where("class <> 'unassigned'").groupBy("member").agg(F.max("class").alias("class"))
    sf = F.when(F.col("class").contains("/"), F.split_part("class", F.lit("/"), F.lit(2))).otherwise("unknown")
    path = scratch(spark)
    e.select(F.concat_ws("\t", "member", F.split_part("class", F.lit("/"), F.lit(1)), sf, F.lit("unknown"), F.lit("no"), F.lit("?"), F.lit("none")).alias("value")).write.text(path)
    return text.read_calls(spark, path, "rexdb")


@query(f"""with {{records}}, {CLASSED} select name, coalesce(class, 'Unknown') as class, length(full_seq) as len, md5(full_seq) as digest from r left join (select member, max(cls) as class from held join cc using (family) group by member) on member = name""")
def classified_fasta(spark, d):
    """Elements with their classes as a classified FASTA, written and read back."""
    c = cl.class_of_elements(held(spark, d).withColumnRenamed("family", "consensus"), consensus_class(spark, d)).where("class <> 'unassigned'").groupBy(F.col("member").alias("te_id")).agg(F.max("class").alias("class_label"))
    r = records(spark, d, "full_seq").join(c.withColumnRenamed("te_id", "name"), "name", "left")
    fixed = {k: F.lit(v).alias(k) for k, v in cl.UNCLASSIFIED.items() if k != "class_label"}
    entries = r.select(F.col("name").alias("te_id"), "full_seq", F.coalesce("class_label", F.lit("Unknown")).alias("class_label"), *fixed.values(), F.lit(None).cast("string").alias("db"))
    path = scratch(spark)
    lines = cl.classified_header(entries).join(entries.select("te_id", "full_seq"), "te_id")
    text.write_fasta(lines, "header", "full_seq", path, 60)
    f = text.read_fasta(spark, path)
    return f.select("name", cl.classified_class(F.concat(F.lit(">"), "header")).alias("class"), F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


def typed_lines(spark, d):
    """Scaffolds of two contigs with a gap between, then the alignments in contig coordinates, as typed lines."""
    s = co.number_rows(table(spark, d, "scaffolds").select("seq_index", "name", "scaf_len"), "seq_index", name="k").withColumn("k", F.col("k") - 1)
    s, _ = materialize(s)
    line = lambda *parts: F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    own = F.array(line("S", F.col("name")), line("C", F.lit(1000)), line("G", F.lit(50)), line("C", F.greatest(F.coalesce("scaf_len", F.lit(0)) - 1050, F.lit(0))))
    heads = s.select(F.lit(0).alias("part"), F.col("k").alias("a"), F.posexplode(own).alias("b", "value"))
    a = table(spark, d, "ltr_aligns").select("scaffold_idx", "r1s", "r1e", "r2s", "r2e").dropna().distinct().join(s.select(F.col("seq_index").alias("scaffold_idx"), "k"), "scaffold_idx")
    right = F.least("r1s", "r1e", "r2s", "r2e") >= 1050
    at = lambda c: F.col(c) - F.when(right, 1050).otherwise(0)
    both = F.array(line("A", F.col("k") * 2 + right.cast("int"), at("r2s"), at("r2e"), F.lit(0), at("r1s"), at("r1e")), F.lit("U"))
    aligns = co.number_rows(a, "k", "r1s", "r1e", "r2s", "r2e", name="o").select(F.lit(1).alias("part"), F.col("o").alias("a"), F.posexplode(both).alias("b", "value"))
    path = scratch(spark)
    heads.unionByName(aligns).repartitionByRange("part", "a", "b").sortWithinPartitions("part", "a", "b").select("value").write.text(path)
    return text.read_line_objects(spark, path)


LINES = "l as (select distinct scaffold_idx, r1s, r1e, r2s, r2e from ltr_aligns where scaffold_idx in (select seq_index from scaffolds) and r1s is not null and r1e is not null and r2s is not null and r2e is not null)"


@query(f"with {LINES} select cast(rank as bigint) as scaffold_idx, r1s, r1e, r2s, r2e from l join (select seq_index, row_number() over (order by seq_index) - 1 as rank from scaffolds) on seq_index = scaffold_idx where r1e <> r1s and r2e <> r2s")
def lined_alignments(spark, d):
    """Alignments read back from typed lines in contig coordinates, in those of their scaffolds."""
    return text.alignments_from_lines(typed_lines(spark, d))


@query(f"with {LINES} select 'S' as kind, count(*) as n from scaffolds union all select 'C', 2 * count(*) from scaffolds union all select 'G', count(*) from scaffolds union all select 'A', count(*) from l union all select 'U', count(*) from l")
def line_kinds(spark, d):
    """How many lines of each kind the file has."""
    return text.line_kinds(typed_lines(spark, d)).select("kind", "n")


@query("""with {records} select regexp_replace(name, '\\s.*', '') || '_' || regexp_replace(split_part(coalesce(genome, 'none'), '.', 1), '[-_.]', '', 'g') as name, 'genome=' || coalesce(genome, 'none') as descr, length(full_seq) as len, md5(full_seq) as digest from r""")
def combined_genomes(spark, d):
    """The elements of all genomes written as one FASTA under names with the label of their genome, and read back."""
    r = records(spark, d, "full_seq", plain=("genome",)).withColumn("genome", F.coalesce("genome", F.lit("none")))
    label = labels.gml_safe(F.substring_index("genome", ".", 1))
    path = scratch(spark)
    text.write_fasta(r.select(F.concat(F.regexp_replace("name", r"\s.*", ""), F.lit("_"), label, F.lit(" genome="), "genome").alias("header"), "full_seq"), "header", "full_seq", path, 60)
    return text.read_fasta(spark, path).select("name", "descr", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))
