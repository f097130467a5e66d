"""Queries on families: components, centroids, consensi, target sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from retromill.operators import consensus as cs
from retromill.operators import graph
from retromill.queries.registry import query
from retromill.queries.sequences import records
from retromill.shared import materialize, table

LINKS = """{records}, e as (select distinct least(name_a, name_b) as a, greatest(name_a, name_b) as b from match_pairs where name_a <> name_b and name_a in (select name from r) and name_b in (select name from r)),
s as (select a, b from e union select b, a from e)"""
FAMILIES = f"""{LINKS}, reach(name, other) as (select a, b from s union select reach.name, s.b from reach join s on reach.other = s.a),
comp as (select name as member, min(other) as component from reach group by name), big as (select component, row_number() over (order by component) as family from comp group by component having count(*) >= 3),
fam as (select family, member from comp join big using (component)), deg as (select name as member, count(*) as degree from (select a as name from s) group by name)"""
HELD = "held as (select distinct m.consensus as family, m.member from members m where m.consensus is not null and m.member is not null)"


def links(spark, d):
    names = table(spark, d, "ltr_records").select("name").where("name is not null").distinct()
    p = table(spark, d, "match_pairs").where("name_a <> name_b").select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).distinct()
    return graph.reused_edges(p, "a", "b", names)


def held(spark, d):
    return table(spark, d, "members").where("consensus is not null and member is not null").select(F.col("consensus").alias("family"), "member").distinct()


@query(f"with recursive {FAMILIES} select family, member from fam")
def families(spark, d):
    """Families of three linked elements or more, numbered by their smallest member."""
    return graph.families(links(spark, d), "a", "b")


@query(f"with recursive {FAMILIES} select size, count(*) as n_families from (select count(*) as size from fam group by family) group by size")
def family_sizes(spark, d):
    return graph.families(links(spark, d), "a", "b").groupBy("family").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n_families"))


@query(f"with recursive {FAMILIES} select family, member as centroid, degree from (select *, row_number() over (partition by family order by degree desc, member) as k from fam join deg using (member)) where k = 1")
def centroids(spark, d):
    e = links(spark, d)
    return graph.centroids(graph.families(e, "a", "b"), graph.degrees(e, "a", "b"))


@query(f"with {LINKS}, n as (select name from r where round > 1) select a, b from e where a in (select name from n) or b in (select name from n)")
def delta_pairs(spark, d):
    """Pairs with at least one element of a later round."""
    new = records(spark, d, "round").where("round > 1")
    return graph.new_pairs(links(spark, d), "a", "b", new)


@query(f"with {LINKS}, n as (select name from r where round = 1) select a, b from e where a in (select name from n) and b in (select name from n)")
def reuse_edges(spark, d):
    """Edges between elements that the first round already had."""
    return graph.reused_edges(links(spark, d), "a", "b", records(spark, d, "round").where("round = 1"))


COLUMNS = """{records}, {held}, c0 as (select family, ltr5 as s from held join r on r.name = member where ltr5 <> ''), nn as (select family, count(*) as n from c0 group by family),
c1 as (select family, s, unnest(range(1, length(s) + 1)) as i from c0), cc as (select family, i - 1 as col, sum(case when substr(s, i, 1) = 'A' then 1 else 0 end) as a, sum(case when substr(s, i, 1) = 'C' then 1 else 0 end) as c,
sum(case when substr(s, i, 1) = 'G' then 1 else 0 end) as g, sum(case when substr(s, i, 1) = 'T' then 1 else 0 end) as t from c1 group by 1, 2),
cl as (select *, a + c + g + t as tot, (case when a / (a + c + g + t) >= 0.4 then 'A' else '' end) || (case when c / (a + c + g + t) >= 0.4 then 'C' else '' end) || (case when g / (a + c + g + t) >= 0.4 then 'G' else '' end) || (case when t / (a + c + g + t) >= 0.4 then 'T' else '' end) as k from cc),
cb as (select family, col, case when tot = 0 then '-' when k = '' then 'N' else {'A': 'A', 'C': 'C', 'G': 'G', 'T': 'T', 'AG': 'R', 'CT': 'Y', 'CG': 'S', 'AT': 'W', 'GT': 'K', 'AC': 'M'}[k] end as base, greatest(a, c, g, t) / n as cons, tot / n as sat, n from cl join nn using (family)),
cons as (select family, any_value(n) as n, string_agg(base, '' order by col) as consensus, string_agg(case when cons >= 0.8 then '1' else '0' end, '' order by col) as bits, list(sat order by col) as saturation from cb group by family),
cr as (select *, repeat('1', greatest(2, 12 - cast(floor(sqrt(greatest(n - 2, 0))) as int))) as run from cons),
bound as (select *, strpos(bits, run) - 1 as first, length(bits) - strpos(reverse(bits), run) as last from cr where strpos(bits, run) > 0)""".replace(
    "{'A': 'A', 'C': 'C', 'G': 'G', 'T': 'T', 'AG': 'R', 'CT': 'Y', 'CG': 'S', 'AT': 'W', 'GT': 'K', 'AC': 'M'}[k]", "case k when 'AG' then 'R' when 'CT' then 'Y' when 'CG' then 'S' when 'AT' then 'W' when 'GT' then 'K' when 'AC' then 'M' else k end"
).replace("{held}", HELD)


def _window(spark, d):
    """The whole left repeats of the members of each consensus, base by base as they are written, none left out: what SQL
    can say of columns. The members in aligned columns are the ``aligned_`` queries."""
    rows = held(spark, d).join(records(spark, d, "ltr5").where("ltr5 <> ''"), F.col("member") == F.col("name")).select("family", F.col("ltr5").alias("row"))
    rows, _ = materialize(rows)
    return cs.column_counts(rows, "family", "row"), rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {COLUMNS} select family, n, consensus from cons")
def majority_consensus(spark, d):
    """Majority letters at each place of the left repeats of the members of each consensus."""
    counts, n = _window(spark, d)
    return cs.majority(counts, n).join(n, "family").select("family", "n", "consensus")


@query(f"with {COLUMNS} select family, col, round(cons, 6) as conservation, round(sat, 6) as saturation from cb")
def conservation(spark, d):
    counts, n = _window(spark, d)
    each = cs.majority(counts, n).select("family", F.posexplode(F.arrays_zip("conservation", "saturation")).alias("col", "x"))
    return each.select("family", F.col("col").cast("long").alias("col"), F.round("x.conservation", 6).alias("conservation"), F.round("x.saturation", 6).alias("saturation"))


@query(f"with {COLUMNS} select family, string_agg(case when greatest(a, c, g, t) = 0 then 'N' when a = greatest(a, c, g, t) then 'A' when c = greatest(a, c, g, t) then 'C' when g = greatest(a, c, g, t) then 'G' else 'T' end, '' order by col) as consensus from cc group by family")
def quick_consensus(spark, d):
    """The most frequent base at each place of the left repeats of the members of each consensus."""
    return cs.quick_consensus(_window(spark, d)[0])


@query(f"""with {COLUMNS}, la as (select family, max(col) as last from cc group by family), rc as (select family, last - col + 10 as col, t as a, g as c, c as g, a as t from cc join la using (family))
select family, cast(col as bigint) as col, cast(sum(a) as bigint) as a, cast(sum(c) as bigint) as c, cast(sum(g) as bigint) as g, cast(sum(t) as bigint) as t from (select family, col, a, c, g, t from cc union all select family, col, a, c, g, t from rc) where family in (select family from la where last >= 10) group by family, col""")
def merged_profiles(spark, d):
    """The column counts of each consensus merged with those of the other strand, ten columns on."""
    counts, _ = materialize(_window(spark, d)[0])
    n = counts.groupBy("family").agg((F.max("col") + 1).alias("n")).where("n > 10")
    return cs.merged_counts(counts, cs.reversed_counts(counts), n.select("family", F.format_string("10D%dM10I", F.col("n") - 10).alias("cigar"))).withColumn("col", F.col("col").cast("long"))


@query(f"with {COLUMNS} select family, cast(first as bigint) as first, cast(last as bigint) as last from bound")
def conserved_bounds(spark, d):
    counts, n = _window(spark, d)
    return cs.boundaries(cs.majority(counts, n), n).where("first is not null").select("family", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(f"with {COLUMNS}, k as (select family, consensus, saturation, unnest(range(first, last + 1)) as i from bound) select family, translate(string_agg(substr(consensus, i + 1, 1), '' order by i), '-', 'N') as seq from k where saturation[i + 1] >= 0.6 group by family")
def occupancy_trim(spark, d):
    counts, n = _window(spark, d)
    return cs.trimmed(cs.boundaries(cs.majority(counts, n), n))


def whole_members(spark, d, fam, e):
    """``family``, ``member``, ``seq`` (the whole element) and ``centroid``, the member with most links among those
    that have a sequence, the smallest name on a tie; written once."""
    both = fam.join(records(spark, d, "full_seq").select(F.col("name").alias("member"), F.col("full_seq").alias("seq")), "member")
    both, _ = materialize(both)
    known = both.where("seq <> ''").select("family", "member")
    degree = known.select("member").distinct().join(graph.degrees(e, "a", "b").withColumnRenamed("node", "member"), "member", "left").select(F.col("member").alias("node"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return both.join(graph.centroids(known, degree).select("family", "centroid"), "family", "left").select("family", "member", "seq", "centroid")


def _whole(spark, d):
    """Whole members of each consensus in the columns of their centroid, on both strands, written once: the column
    counts, and how many could be aligned."""
    rows, _ = materialize(cs.star_rows(whole_members(spark, d, held(spark, d), links(spark, d))).select("family", "row"))
    return cs.column_counts(rows, "family", "row"), cs.sizes(rows)


@query()
def aligned_consensus(spark, d):
    """Majority letters of the whole members of each consensus; ``n_failed`` members could not be aligned."""
    counts, n = _whole(spark, d)
    return cs.majority(counts, n.drop("n_failed")).join(n, "family").select("family", "n", "n_failed", "consensus")


@query()
def aligned_conservation(spark, d):
    counts, n = _whole(spark, d)
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    both = counts.join(n, "family")
    return both.select("family", F.col("col").cast("long").alias("col"), F.round(F.greatest("a", "c", "g", "t") / F.col("n"), 6).alias("conservation"), F.round(total / F.col("n"), 6).alias("saturation"))


@query()
def aligned_bounds(spark, d):
    counts, n = _whole(spark, d)
    n = n.drop("n_failed")
    return cs.boundaries(cs.majority(counts, n), n).where("first is not null").select("family", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query()
def aligned_trim(spark, d):
    counts, n = _whole(spark, d)
    n = n.drop("n_failed")
    return cs.trimmed(cs.boundaries(cs.majority(counts, n), n))


@query(f"""with {{records}}, {HELD}, e as (select family, member, flank_l as l, flank_r as r2 from held join r on r.name = member where flank_l <> '' and flank_r <> ''), nn as (select family, count(*) as n_edges from e group by family),
h as (select family, k, substr(r2, 1, k) as m from (select *, unnest(range(2, 14)) as k from e) where length(l) >= k and length(r2) >= k and right(l, k) = substr(r2, 1, k)),
b as (select family, k, n_match from (select family, k, count(*) as n_match, row_number() over (partition by family order by count(*) desc, k) as best from h group by family, k) where best = 1),
x as (select family, loc, array_to_string(list_sort(list(distinct base) filter (base in ('A', 'C', 'G', 'T'))), '') as key from (select family, loc, substr(m, loc, 1) as base from (select h.*, unnest(range(1, h.k + 1)) as loc from h join b using (family, k))) group by family, loc),
mo as (select family, string_agg(case coalesce(key, '') when 'AG' then 'R' when 'CT' then 'Y' when 'CG' then 'S' when 'AT' then 'W' when 'GT' then 'K' when 'AC' then 'M' when 'CGT' then 'B' when 'AGT' then 'D' when 'ACT' then 'H' when 'ACG' then 'V' when 'ACGT' then 'N' when '' then 'N' else key end, '' order by loc) as tsd_motif from x group by family)
select family, n_edges, cast(coalesce(k, 0) as int) as tsd_len, coalesce(n_match, 0) as n_match, coalesce(tsd_motif, '') as tsd_motif from nn left join b using (family) left join mo using (family)""")
def target_sites(spark, d):
    """Target site duplications by the flanks of the members of each consensus."""
    e = held(spark, d).join(records(spark, d, "flank_l", "flank_r"), F.col("member") == F.col("name"))
    return cs.target_site(e, "family", "flank_l", "flank_r").drop("tsd_conf")


@query()
def star_consensus(spark, d):
    """Consensi of all families from whole elements: each member aligned to the centroid by itself."""
    e = links(spark, d)
    return cs.star_consensus(whole_members(spark, d, graph.families(e, "a", "b"), e))


@query()
def consensus_alignments(spark, d):
    """The whole elements of each family in the columns of their consensus, with columns for insertions."""
    e = links(spark, d)
    members, _ = materialize(whole_members(spark, d, graph.families(e, "a", "b"), e))
    consensi, _ = materialize(cs.star_consensus(members).where("seq <> ''").select("family", F.col("seq").alias("cseq")))
    return cs.consensus_rows(members, consensi)


@query("""with recursive {records}, c as (select distinct name, cluster, tag, num_sequences, tsd_len, tsd_conf, tsd_motif, upper(seq) as seq from consensi where name is not null and seq is not null)
select name, 'CONS_' || cluster || coalesce(tag, '') || '-' || length(seq) || '_clus' || coalesce(cast(num_sequences as varchar), 'none') || '_tsdl' || tsd_len || '_tsdm' || coalesce(nullif(tsd_motif, ''), 'none') as made from c where cluster is not null and tsd_len is not null""")
def consensus_names(spark, d):
    """The names of consensi, put together from their parts."""
    c = table(spark, d, "consensi").where("name is not null and seq is not null and cluster is not null and tsd_len is not null").select("name", "cluster", "tag", "num_sequences", "tsd_len", "tsd_motif", F.upper("seq").alias("seq")).distinct()
    parts = [F.lit("CONS_"), "cluster", F.coalesce("tag", F.lit("")), F.lit("-"), F.length("seq"), F.lit("_clus"), F.coalesce(F.col("num_sequences").cast("string"), F.lit("none")), F.lit("_tsdl"), "tsd_len", F.lit("_tsdm"), F.coalesce(F.when(F.col("tsd_motif") != "", F.col("tsd_motif")), F.lit("none"))]
    return c.select("name", F.concat(*parts).alias("made"))


@query(f"with {HELD} select family as consensus, string_agg(member, ',' order by member) as members, repeat(chr(97 + cast((count(*) - 1) % 26 as int)), cast((count(*) - 1) // 26 as int) + 1) as size_tag from held group by family")
def membership_lines(spark, d):
    """One line for each consensus with its members, and its size in subfamily letters."""
    h = held(spark, d).groupBy("family").agg(F.array_join(F.sort_array(F.collect_list("member")), ",").alias("members"), F.count(F.lit(1)).alias("n"))
    return h.select(F.col("family").alias("consensus"), "members", cs.subfamily_tag(F.col("n") - 1).alias("size_tag"))


@query(f"""with recursive {FAMILIES}, near as (select least(name_a, name_b) as a, greatest(name_a, name_b) as b from match_pairs where name_a <> name_b group by 1, 2 having min(ltr_div_pct + int_div_pct) <= 8),
ne as (select a, b from near semi join e using (a, b)), ns as (select a, b from ne union select b, a from ne),
nreach(name, other) as (select a, b from ns union select nreach.name, ns.b from nreach join ns on nreach.other = ns.a), ncomp as (select name as member, min(other) as component from nreach group by name),
h as (select *, row_number() over (partition by family order by component) - 1 as i, count(*) over (partition by family) as n from (select distinct family, component from ncomp join fam using (member)))
select fam.family, case when n > 1 then repeat(chr(97 + cast(i % 26 as int)), cast(i // 26 as int) + 1) else '' end as tag, fam.member from ncomp join fam using (member) join h on h.component = ncomp.component and h.family = fam.family""")
def subfamilies(spark, d):
    """Groups of close members within families: mean divergence of repeats and internal parts of 4 % at most."""
    e = links(spark, d)
    p = table(spark, d, "match_pairs").where("name_a <> name_b").groupBy(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).agg(F.min(F.col("ltr_div_pct") + F.col("int_div_pct")).alias("sum"))
    near = p.join(e, ["a", "b"], "left_semi").withColumn("distance", F.col("sum") / 200)
    return graph.subfamilies(near, "a", "b", "distance", graph.families(e, "a", "b"), 0.04)
