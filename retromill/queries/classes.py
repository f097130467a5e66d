"""Queries on classes of library entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from retromill.operators import classes as cl
from retromill.queries.intervals import ELEMENTS, elements
from retromill.operators import coordinates as co
from retromill.operators import graph
from retromill.queries.families import FAMILIES, HELD, held, links
from retromill.queries.registry import query
from retromill.shared import table

LTR = "regexp_matches(regexp_replace(trim({}), '[?]+$', ''), '(?i)^LTR(/|$)')"
CLASSED = f"""{HELD}, hit as (select hit_id, any_value(name) as name, any_value(partner) as partner from seed_hits group by hit_id),
rc as (select name, max(te_class) as cls from ref_library where te_class is not null group by name),
v as (select family, cls, count(*) as n from hit join held on partner = member join rc on rc.name = hit.name group by family, cls),
cc as (select family, cls from (select *, row_number() over (partition by family order by n desc, cls) as k from v) where k = 1)"""


def consensus_class(spark, d):
    from retromill.operators.skew import distinct_hits

    hits = distinct_hits(table(spark, d, "seed_hits")).where("name is not null and partner is not null").groupBy("name", "partner").agg(F.count(F.lit(1)).alias("n"))
    ref = table(spark, d, "ref_library").where("te_class is not null").groupBy("name").agg(F.max("te_class").alias("cls"))
    votes = hits.join(ref, "name").groupBy(F.col("partner").alias("member"), "cls").agg(F.sum("n").alias("n")).join(held(spark, d), "member").groupBy("family", "cls").agg(F.sum("n").alias("n"))
    return votes.groupBy("family").agg(F.min(F.struct((-F.col("n")).alias("less"), "cls")).alias("x")).select(F.col("family").alias("consensus"), F.col("x.cls").alias("class"))


#: the entries to classify: the library, and all elements with the class of their consensus
LIB = f"""{CLASSED}, lib as (select name, te_class, strand, clade from ref_library union all select member, cls, null, null from held left join cc using (family))"""


def library(spark, d):
    e = cl.class_of_elements(held(spark, d).withColumnRenamed("family", "consensus"), consensus_class(spark, d))
    none = F.lit(None).cast("string")
    e = e.select(F.col("member").alias("name"), F.when(F.col("class") != "unassigned", F.col("class")).alias("te_class"), none.alias("strand"), none.alias("clade"))
    return table(spark, d, "ref_library").select("name", "te_class", "strand", "clade").unionByName(e)


#: every third entry of the library has its class in the name, the others in a token
HEADERS = f"""{LIB}, h as (select name, case when te_class is null then '>' || name || ' strand=' || coalesce(strand, '?') when ascii(right(name, 1)) % 3 = 0 then '>' || name || '#' || te_class || ' strand=' || coalesce(strand, '?')
else '>' || name || ' class=' || te_class || ' strand=' || coalesce(strand, '?') end as header from lib)"""
CALLS = f"""{LIB}, c as (select case when strand = '+' then 'rexdb' else 'gydb' end as db, name as te_id, split_part(te_class, '/', 1) as o, case when contains(te_class, '/') then split_part(te_class, '/', 2) else 'unknown' end as sf, coalesce(strand, '?') as strand, coalesce(clade, 'unknown') as clade from lib where te_class is not null and name is not null
union all select 'gydb', name, 'LTR', 'Pao', '-', 'unknown' from lib where clade is null and name is not null),
k as (select db, te_id, strand, clade, case when o = 'LTR' and s <> 'unknown' then 'LTR/' || s when o <> 'Unknown' then o || '/unknown' else 'Unknown' end as class_label from (select *, case sf when 'Pao' then 'Bel-Pao' when 'Retroviridae' then 'Retrovirus' else sf end as s from c))"""


def headers(spark, d):
    r = library(spark, d)
    strand = F.concat(F.lit(" strand="), F.coalesce("strand", F.lit("?")))
    name = F.concat(F.lit(">"), "name")
    h = F.when(F.col("te_class").isNull(), F.concat(name, strand)).when(F.ascii(F.right("name", F.lit(1))) % 3 == 0, F.concat(name, F.lit("#"), "te_class", strand)).otherwise(F.concat(name, F.lit(" class="), "te_class", strand))
    return r.select("name", h.alias("header"))


def calls(spark, d):
    r = library(spark, d).where("name is not null")
    sf = F.when(F.col("te_class").contains("/"), F.split_part("te_class", F.lit("/"), F.lit(2))).otherwise("unknown")
    one = r.where("te_class is not null").select(F.when(F.col("strand") == "+", "rexdb").otherwise("gydb").alias("db"), F.col("name").alias("te_id"), F.split_part("te_class", F.lit("/"), F.lit(1)).alias("o"), sf.alias("sf"), F.coalesce("strand", F.lit("?")).alias("strand"), F.coalesce("clade", F.lit("unknown")).alias("clade"))
    two = r.where("clade is null").select(F.lit("gydb").alias("db"), F.col("name").alias("te_id"), F.lit("LTR").alias("o"), F.lit("Pao").alias("sf"), F.lit("-").alias("strand"), F.lit("unknown").alias("clade"))
    both = one.unionByName(two)
    return both.select("db", "te_id", cl.class_label(F.col("o"), F.col("sf")).alias("class_label"), F.lit("none").alias("domains"), "strand", F.lit("no").alias("complete"), "clade")


@query(f"with {CALLS} select db, te_id, strand, clade, class_label from k")
def classifier_calls(spark, d):
    """Calls of two databases with their labels made from order and superfamily."""
    return calls(spark, d).drop("domains", "complete")


@query(f"""with {CALLS}, b as (select *, row_number() over (partition by te_id, db order by class_label desc, domains desc, strand desc, complete desc, clade desc) as v from (select *, 'none' as domains, 'no' as complete from k)),
p as (select *, row_number() over (partition by te_id order by not {LTR.format('class_label')}, case db when 'rexdb' then 0 else 1 end) as best from b where v = 1),
ids as (select name as te_id from lib where name is not null union select name from consensi where name is not null)
select ids.te_id, db, coalesce(class_label, 'Unknown') as class_label, coalesce(domains, 'none') as domains, coalesce(strand, '?') as strand, coalesce(complete, 'no') as complete, coalesce(clade, 'unknown') as clade from ids left join p on p.te_id = ids.te_id and best = 1""")
def class_merge(spark, d):
    """One call for each library entry and consensus from two databases, LTR calls first."""
    ids = library(spark, d).select(F.col("name").alias("te_id")).union(table(spark, d, "consensi").select("name")).where("te_id is not null")
    return cl.merge_calls(ids, calls(spark, d), ["rexdb", "gydb"])


@query(f"""with {CALLS}, b as (select te_id, class_label, db, {LTR.format('class_label')} as ltr from k) select class_label, db, count(*) as n, cast(sum(case when ltr then 1 else 0 end) as bigint) as n_ltr from b group by class_label, db""")
def class_counts(spark, d):
    c = calls(spark, d)
    return c.groupBy("class_label", "db").agg(F.count(F.lit(1)).alias("n"), F.sum(cl.is_ltr(F.col("class_label")).cast("long")).alias("n_ltr"))


@query(f"""with {HEADERS} select name as entry, case when contains(header, ' class=') then regexp_extract(header, ' class=(\\S+)', 1) else 'unknown' end as classified,
case when contains(header, ' class=') then regexp_extract(header, ' class=(\\S+)', 1) when contains(header, '#') then regexp_extract(header, '#(\\S*)', 1) else 'Unknown' end as library from h""")
def parsed_classes(spark, d):
    """The class of each entry as read from a classified header and from a library header."""
    h = F.col("header")
    return headers(spark, d).select(F.col("name").alias("entry"), cl.classified_class(h).alias("classified"), cl.library_class(h).alias("library"))


@query(f"""with {HEADERS}, twice as (select name, header from h union all select name, header from h where ascii(right(name, 1)) % 2 = 0),
o as (select *, row_number() over (order by header) as ord from twice), p as (select ord, header, case when contains(header, ' class=') then regexp_extract(header, ' class=(\\S+)', 1) when contains(header, '#') then regexp_extract(header, '#(\\S*)', 1) else 'Unknown' end as cls, regexp_extract(header, '^>([^#\\s]*)', 1) as nm from o),
q as (select *, row_number() over (partition by nm order by ord) as k from p where {LTR.format('cls')})
select header, '>' || nm || case when k > 1 then '_' || k else '' end || '#' || cls as rm_header from q""")
def final_library(spark, d):
    """LTR entries and their names for masking; repeated names are numbered."""
    h = headers(spark, d)
    twice = h.unionByName(h.where(F.ascii(F.right("name", F.lit(1))) % 2 == 0))
    return cl.final_library(cl.numbered(twice.select("header"), "header")).select("header", "rm_header")


@query(f"""with {ELEMENTS} select name, scaffold, r1s as r1_start, r2e as r2_end from e""")
def element_coordinates(spark, d):
    """Coordinates of all elements, read back from their description lines."""
    return cl.element_coordinates(co.element_header(elements(spark, d)))


@query("""with {records} select name, full_seq, substr(full_seq, 101, 150) as ltr5, substr(full_seq, 251, greatest(length(full_seq) - 500, 0)) as internal, case when length(full_seq) > 500 then substr(full_seq, length(full_seq) - 249, 150) else substr(full_seq, 251, 150) end as ltr3,
substr(full_seq, 1, 100) as flank_l, case when length(full_seq) > 500 then right(full_seq, 100) else substr(full_seq, 401) end as flank_r, genome from r where genome is not null and not regexp_matches(genome, '\\s') and genome <> ''""")
def feature_slice(spark, d):
    """Features cut from the full sequences by the coordinates in description lines: repeats of 150
    bases inside flanks of 100."""
    from retromill.queries.sequences import records

    r = records(spark, d, "full_seq", plain=("genome",)).where("genome is not null and not genome rlike '\\\\s' and genome <> ''")
    n = F.greatest(F.length("full_seq"), F.lit(500))
    at = lambda x: (n - x + 1000).cast("string")
    header = F.concat(F.lit(">"), "name", F.lit(" scaffold=s flank_l=1000-1100 repeat1=1100-1250 repeat2="), at(250), F.lit("-"), at(100), F.lit(" flank_r="), at(100), F.lit("-"), at(0), F.lit(" genome="), "genome")
    return cl.load_elements(r.select(header.alias("header"), F.col("full_seq").alias("seq")))


@query(f"with {CLASSED} select member, family as consensus, coalesce(cls, 'unassigned') as class from held left join cc using (family)")
def element_classes(spark, d):
    """The class of each member by that of its consensus, which library elements vote on by their hits."""
    return cl.class_of_elements(held(spark, d).withColumnRenamed("family", "consensus"), consensus_class(spark, d))


@query(f"""with recursive {FAMILIES}, {CLASSED}, mc as (select member, max(cls) as cls from held left join cc using (family) group by member),
nodes as (select r.name as node, coalesce(mc.cls, 'unassigned') as class, coalesce(comp.component, r.name) as component from r left join mc on mc.member = r.name left join comp on comp.member = r.name)
select node, class, component from nodes where component not in (select component from nodes where class in ('unassigned', 'non-LTR'))""")
def classified_components(spark, d):
    """Components of linked elements of which every element has the class of a consensus."""
    e = cl.class_of_elements(held(spark, d).withColumnRenamed("family", "consensus"), consensus_class(spark, d))
    best = e.where("class <> 'unassigned'").groupBy(F.col("member").alias("name")).agg(F.max("class").alias("class"))
    names = table(spark, d, "ltr_records").select("name").where("name is not null").distinct()
    return graph.without_classes(names.join(best, "name", "left").withColumnRenamed("name", "node"), links(spark, d), "a", "b")


@query(f"with {CLASSED} select coalesce(cls, 'unassigned') as class, {LTR.format('cls')} is true as ltr, count(distinct family) as n_families, count(*) as n_members from held left join cc using (family) group by 1, 2")
def family_classes(spark, d):
    e = cl.class_of_elements(held(spark, d).withColumnRenamed("family", "consensus"), consensus_class(spark, d))
    return e.groupBy("class", cl.is_ltr(F.col("class")).alias("ltr")).agg(F.count_distinct("consensus").alias("n_families"), F.count(F.lit(1)).alias("n_members"))
