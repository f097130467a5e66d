"""Queries on single sequences and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from retromill.functions import dna, labels
from retromill.operators import seeds, stats
from retromill.queries.registry import query
from retromill.shared import table
from retromill.sources.records import distinct_records


def records(spark, d, *columns, plain=()):
    return distinct_records(table(spark, d, "ltr_records"), *columns, plain=plain)


@query("with {records} select name, reverse(translate(full_seq, 'ACGTacgt', 'TGCAtgca')) as rc from r")
def reverse_complements(spark, d):
    return records(spark, d, "full_seq").select("name", dna.reverse_complement(F.col("full_seq")).alias("rc"))


@query("select distinct name, reverse(translate(upper(seq), 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) as rc from consensi where name is not null and seq is not null")
def reverse_complements_iupac(spark, d):
    c = table(spark, d, "consensi").where("name is not null and seq is not null").select("name", F.upper("seq").alias("s")).distinct()
    return c.select("name", dna.reverse_complement_iupac(F.col("s")).alias("rc"))


@query("""with {records} select name, array_to_string(list_filter(string_split(full_seq, ''), lambda x, i: i = 1 or x <> substr(full_seq, i - 1, 1)), '') as hoco from r""")
def homopolymer_compressed(spark, d):
    return records(spark, d, "full_seq").select("name", dna.homopolymer_compress(F.col("full_seq")).alias("hoco"))


@query("""with {records} select name, full_seq as seq, (select count(*) from unnest(range(1, length(full_seq) + 1)) t(i) where i = 1 or substr(full_seq, i, 1) <> substr(full_seq, i - 1, 1)) as n_runs from r""")
def homopolymer_expanded(spark, d):
    """Elements compressed to one letter for each run, and expanded again by the lengths of the runs."""
    r = records(spark, d, "full_seq")
    packed = r.select("name", dna.homopolymer_compress(F.col("full_seq")).alias("hoco"), dna.homopolymer_lengths(F.col("full_seq")).alias("runs"))
    return packed.select("name", dna.homopolymer_expand(F.col("hoco"), F.col("runs")).alias("seq"), F.size("runs").cast("long").alias("n_runs"))


@query("""with {records}, p as (select name, 'genomes/' || coalesce(genome, 'none') || '-1_' || name || case when round = 1 then '.pri.1.fa.gz' when round = 2 then '.alt.fa' else '.fa.gz' end as path from r)
select name, split_part(split_part(path, '/', 2), '.', 1) as label, case when contains(path, '.pri.') then '.pri' when contains(path, '.alt.') then '.alt' else '' end as haplotype, regexp_replace(split_part(split_part(path, '/', 2), '.', 1), '[-_.]', '', 'g') as safe from p""")
def genome_labels(spark, d):
    """Label, haplotype and safe label of files named by genome, element and round."""
    end = F.when(F.col("round") == 1, ".pri.1.fa.gz").when(F.col("round") == 2, ".alt.fa").otherwise(".fa.gz")
    p = records(spark, d, "round", plain=("genome",)).select("name", F.concat(F.lit("genomes/"), F.coalesce("genome", F.lit("none")), F.lit("-1_"), "name", end).alias("path"))
    label = labels.genome_label(F.col("path"))
    return p.select("name", label.alias("label"), labels.haplotype_tag(F.col("path")).alias("haplotype"), labels.gml_safe(label).alias("safe"))


@query("""with {records}, o as (select name, full_seq as s from r),
x as (select name, s, unnest(range(1, length(s) + 1)) as i from o),
y as (select name, i, substr(s, i, 1) as base from x where i = 1 or substr(s, i, 1) <> substr(s, i - 1, 1)),
z as (select name, base, coalesce(lead(i) over (partition by name order by i), (select length(s) + 1 from o where o.name = y.name)) - i as run_len from y)
select base, run_len, count(*) as n_runs from z group by base, run_len""")
def homopolymer_runs(spark, d):
    """The run lengths that compression takes out: how many runs of each base and length."""
    runs = records(spark, d, "full_seq").select(F.explode(F.regexp_extract_all("full_seq", F.lit(r"((.)\2*)"), F.lit(1))).alias("run"))
    return runs.groupBy(F.substring("run", 1, 1).alias("base"), F.length("run").cast("long").alias("run_len")).agg(F.count(F.lit(1)).alias("n_runs"))


@query("with {records} select name, lower(substr(full_seq, 11, 90)) as part from r")
def subsequences(spark, d):
    """Bases 10 to 100, counted from 0, half-open, in lower case."""
    return records(spark, d, "full_seq").select("name", F.lower(F.substring("full_seq", 11, 90)).alias("part"))


@query()
def requested_subsequences(spark, d):
    """The stretches that requests 'name:start-end' name: here the words of 12 bases at which hits touch their partners."""
    hits = table(spark, d, "seed_hits").where("partner is not null and pj is not null")
    requests = hits.select(F.concat("partner", F.lit(":"), F.col("pj").cast("string"), F.lit("-"), (F.col("pj") + 12).cast("string")).alias("request"))
    return stats.subsequences(records(spark, d, "full_seq").withColumnRenamed("full_seq", "seq"), requests)


@query("with {records} select count(*) as n_seqs, cast(sum(length(full_seq)) as bigint) as total_len, round(avg(length(full_seq)), 2) as avg_len, min(length(full_seq)) as min_len, max(length(full_seq)) as max_len from r")
def sequence_stats(spark, d):
    return stats.sequence_stats(records(spark, d, "full_seq"), "full_seq")


@query("""with {records}, c as (select case when x in ('a', 'c', 'g', 't', 'n') then x else 'other' end as base from (select unnest(string_split(lower(full_seq), '')) as x from r where full_seq <> ''))
select b.base, count(c.base) as n from (select unnest(['a', 'c', 'g', 'n', 't', 'other']) as base) b left join c using (base) group by b.base""")
def base_composition(spark, d):
    return stats.base_composition(records(spark, d, "full_seq"), "full_seq")


@query("""with {records}, l as (select length(full_seq) as len, sum(length(full_seq)) over (order by length(full_seq) desc) as above from r)
select max(len) as n50 from l where above >= 0.5 * (select sum(length(full_seq)) from r)""")
def n50(spark, d):
    return stats.length_quantile(records(spark, d, "full_seq"), "full_seq")


@query("""with {records}, b as (select cast(floor(sqrt(length(full_seq))) as bigint) as bin from r)
select bin, bin * bin as from_len, count(*) as n_seqs from b group by bin""")
def length_histogram(spark, d):
    return stats.length_histogram(records(spark, d, "full_seq"), "full_seq")


@query("""with {records} select name, case when length(internal) >= 300 then internal else '' end as internal, case when length(ltr5) >= 80 then ltr5 else '' end as ltr5 from r""")
def min_len_gate(spark, d):
    """Features that are too short to be compared become empty."""
    gate = lambda c, least: F.when(F.length(c) >= least, F.col(c)).otherwise("").alias(c)
    return records(spark, d, "ltr5", "internal").select("name", gate("internal", 300), gate("ltr5", 80))


@query("""with {records}, w as (select name, substr(ltr5, i, 12) as w, i - 1 as pos from (select name, ltr5, unnest(range(1, length(ltr5) - 10)) as i from r where length(ltr5) >= 12))
select name, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as word, min(pos) as pos, count(*) as n from w where regexp_full_match(w, '[ACGT]{12}') group by 1, 2""")
def canonical_words(spark, d):
    """Canonical 12-base words of each left repeat with their smallest position and number."""
    return seeds.canonical_words(records(spark, d, "ltr5"), "name", "ltr5")


@query("""with {records} select genome, count(*) as n_records, cast(sum(length(ltr5)) as bigint) as ltr5_len, cast(sum(case when length(internal) >= 300 then 1 else 0 end) as bigint) as n_internal,
case when sum(case when length(internal) >= 300 then 1 else 0 end) = 0 then 3 else greatest(3, cast(floor(floor(sum(case when length(internal) >= 300 then length(internal) else 0 end) / sum(case when length(internal) >= 300 then 1 else 0 end)) / 1000) as bigint)) end as int_min_shared
from r group by genome""")
def adaptive_thresholds(spark, d):
    """Per genome: elements with an internal part of 300 bases or more, and how many words two of
    them must share, one for each 1,000 bases of the mean length, 3 at least."""
    some = F.length("internal") >= 300
    n = F.sum(some.cast("long"))
    mean = F.sum(F.when(some, F.length("internal")).otherwise(0)) / n
    least = F.when(n == 0, F.lit(3).cast("long")).otherwise(F.greatest(F.lit(3).cast("long"), F.floor(F.floor(mean) / 1000)))
    return records(spark, d, "ltr5", "internal", plain=("genome",)).groupBy("genome").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.length("ltr5")).alias("ltr5_len"), n.alias("n_internal"), least.alias("int_min_shared"))
