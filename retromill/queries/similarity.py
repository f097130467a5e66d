"""Queries on pairs of elements: seeds, anchors, verified edges, flanks."""

from __future__ import annotations

from pyspark.sql import functions as F

from retromill.functions.dna import reverse_complement
from retromill.operators import alignment as al
from retromill.operators import graph, seeds
from retromill.operators.consensus import star_consensus
from retromill.queries.registry import query
from retromill.queries.sequences import records
from retromill.shared import materialize, table

ELEMENTS = """{records}, el as (select *, row_number() over (order by full_seq, name) - 1 as elem from r), n as (select count(*) as n from r),
sides as (select elem as id, ltr5 as seq from el union all select elem + n, ltr3 from el, n)"""


def postings_sql(name: str, source: str) -> str:
    return f"""{name}0 as (select id, length(seq) as len, i - 1 as loc, substr(seq, i, 12) as w from (select id, seq, unnest(range(1, length(seq) - 10)) as i from {source} where length(seq) >= 12)),
{name}1 as (select *, row_number() over (partition by id order by loc) - 1 as p, count(*) over (partition by id) as n from {name}0 where regexp_full_match(w, '[ACGT]{{12}}')),
{name} as (select least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as word, id, min(least(case when n > 1 then (p * (len - 12) + (n - 1) // 2) // (n - 1) else 0 end, 65535)) as pos, any_value(len) as len from {name}1 group by 1, 2)"""


def events_sql(name: str, post: str, cap: int, same: str = "true") -> str:
    return f"""{name} as (select a.id as i, b.id as j, a.pos as pi, b.pos as pj, word from {post} a join {post} b using (word) where a.id < b.id and {same} and greatest(a.len, b.len) <= least(a.len, b.len) * 1.25
and word in (select word from {post} group by word having count(*) between 2 and {cap}))"""


def anchors_sql(name: str, events: str, least: str = "3") -> str:
    return f"""{name}0 as (select i, j, count(*) as n_shared, sum(pi) as si, sum(pj) as sj, count(*) * sum(pi * pj) - sum(pi) * sum(pj) < 0 as is_rc from {events} group by i, j having count(*) >= {least}),
{name} as (select i, j, n_shared, is_rc, pi, pj from (select *, row_number() over (partition by i, j order by abs(n_shared * (case when is_rc then pi + pj else pi - pj end) - (case when is_rc then si + sj else si - sj end)), pi, word) as k from {name}0 join {events} using (i, j)) where k = 1)"""


def verified_sql(name: str, anchors: str, sides: str, least: int) -> str:
    lev = lambda a, b, t, lmax: f"case when length({a}) = 0 or length({b}) = 0 or levenshtein({a}, {b}) > (case when {t} <= 0 then {lmax} // 4 + 1 else {t} end) then -1 else levenshtein({a}, {b}) end"
    return f"""{name}0 as (select c.*, a.seq as a, case when is_rc then reverse(translate(b.seq, 'ACGTacgt', 'TGCAtgca')) else b.seq end as b, case when is_rc then length(b.seq) - pj - 12 else pj end as qj from {anchors} c join {sides} a on a.id = i join {sides} b on b.id = j where length(a.seq) >= {least} and length(b.seq) >= {least}),
{name}1 as (select *, greatest(length(a), length(b)) as lmax, cast(floor(greatest(length(a), length(b)) * 0.25) as int) + 1 as budget, least(pi, length(a)) as pa, least(qj, length(b)) as pb from {name}0 where cast(least(length(a), length(b)) / greatest(length(a), length(b)) as float) >= cast(0.8 as float)),
{name}2 as (select *, substr(a, pa + 1) as ar, substr(b, pb + 1) as br, substr(a, 1, pa) as al, substr(b, 1, pb) as bl, greatest(length(a) - pa, length(b) - pb) as lr, greatest(pa, pb) as ll from {name}1),
{name}3 as (select *, case when lr + ll > 0 then budget * lr // (lr + ll) + 1 else budget // 2 + 1 end as rb from {name}2),
{name}4 as (select *, case when pa > 0 and pb > 0 then {lev('ar', 'br', 'rb', 'lr')} end as dr, case when pa > 0 and pb > 0 then {lev('al', 'bl', 'greatest(budget - rb, 0)', 'll')} end as dl, case when pa > 0 and pb > 0 then null else {lev('a', 'b', 'budget', 'lmax')} end as dw from {name}3),
{name} as (select i, j, is_rc, edits, ident from (select *, greatest(cast(1 - edits / lmax as float), cast(0 as float)) as ident from (select *, case when dw is not null then dw when dr < 0 or dl < 0 then -1 else dr + dl end as edits from {name}4) where edits >= 0) where ident >= cast(0.8 as float))"""


LTR = f"{ELEMENTS}, {postings_sql('post', 'sides')}, {events_sql('ev', 'post', 100, 'a.id % (select n from n) <> b.id % (select n from n)')}, {anchors_sql('anc', 'ev')}"
PASSED = f"{LTR}, {verified_sql('ver', 'anc', 'sides', 80)}, passed as (select least(i % n, j % n) as i, greatest(i % n, j % n) as j, max(ident) as ltr_ident from ver, n group by 1, 2)"
INNER = f"""{PASSED}, inn as (select elem as id, internal as seq from el where length(internal) >= 300 and elem in (select i from passed union select j from passed)),
{postings_sql('ipost', 'inn')}, {events_sql('iev', 'ipost', 25)}, {anchors_sql('ianc0', 'iev', '(select greatest(3, coalesce(floor(avg(length(seq)) / 1000), 0)) from inn)')},
ianc as (select ianc0.* from ianc0 join passed using (i, j)), {verified_sql('iver', 'ianc', 'inn', 300)}, edges as (select i, j, ltr_ident, max(iver.ident) as int_ident from passed join iver using (i, j) group by 1, 2, 3)"""
FLANKS = """fl as (select elem, flank_l, flank_r from el where length(flank_l) >= 50 and length(flank_r) >= 50),
fp as (select i, j, unnest([a.flank_l, a.flank_r]) as a, b.flank_l as bl, b.flank_r as br from passed join fl a on a.elem = i join fl b on b.elem = j),
fq as (select i, j, a, unnest([bl, br, reverse(translate(bl, 'ACGTacgt', 'TGCAtgca')), reverse(translate(br, 'ACGTacgt', 'TGCAtgca'))]) as b from fp),
match as (select distinct i, j from (select *, greatest(length(a), length(b)) as lmax, levenshtein(a, b) as d from fq where cast(least(length(a), length(b)) / greatest(length(a), length(b)) as float) >= cast(0.8 as float)) where d <= floor(lmax * 0.25) + 1 and cast(1 - d / lmax as float) >= cast(0.8 as float))"""


def elements(spark, d):
    """Numbered elements, written once, and how many there are."""
    e = al.numbered_elements(records(spark, d, "full_seq", "ltr5", "internal", "ltr3", "flank_l", "flank_r", plain=("genome",)))
    e, facts = materialize(e, F.count(F.lit(1)).alias("n"))
    return e, facts["n"]


def passed_pairs(e, n):
    return materialize(al.ltr_edges(e, n))[0]


def named(edges, e):
    a, b = (e.select(F.col("elem").alias(i), F.col("name").alias(f"name_{i}")) for i in "ij")
    return edges.join(a, "i").join(b, "j")


@query(f"with {ELEMENTS}, {postings_sql('post', 'sides')} select size, count(*) as n_words from (select word, count(*) as size from post group by word) group by size")
def bucket_sizes(spark, d):
    """How many words are in so many repeats."""
    e, n = elements(spark, d)
    return seeds.bucket_sizes(seeds.word_counts(al.ltr_sides(e, n), "id", "seq"))


@query(f"with {ELEMENTS}, {postings_sql('post', 'sides')} select case when size <= 20 then size end as size, count(*) as n_words from (select word, count(*) as size from post group by word having count(*) >= 2) group by 1")
def bucket_overflow(spark, d):
    """How many words 2 to 20 repeats share, and how many more than 20 do."""
    e, n = elements(spark, d)
    return seeds.bucket_histogram(seeds.word_counts(al.ltr_sides(e, n), "id", "seq"), 20)


@query(f"with {ELEMENTS}, lefts as (select elem as id, ltr5 as seq from el), {postings_sql('post', 'lefts')}, {events_sql('ev', 'post', 50)} select i, j, cast(pi as int) as pi, cast(pj as int) as pj from ev")
def seed_events(spark, d):
    """Every word that two left repeats share, with its positions."""
    e, _ = elements(spark, d)
    return seeds.shared_words(e, "elem", "ltr5", 50, 1.25).drop("word")


@query(f"with {LTR} select i, j, n_shared, is_rc, cast(pi as int) as pi, cast(pj as int) as pj from anc")
def seed_anchors(spark, d):
    """Pairs of repeats with three shared words or more: strand and anchor."""
    e, n = elements(spark, d)
    return al.ltr_seeds(e, n).drop("sa", "sb")


@query(f"with {PASSED} select a.name as name_i, b.name as name_j, cast(ltr_ident as double) as ltr_ident from passed join el a on a.elem = i join el b on b.elem = j")
def ltr_passing(spark, d):
    """Pairs of elements whose repeats pass the identity and coverage rules."""
    e, n = elements(spark, d)
    return named(passed_pairs(e, n), e).select("name_i", "name_j", F.col("ltr_ident").cast("double").alias("ltr_ident"))


@query(f"with {PASSED}, {FLANKS} select i, j from match")
def flank_matches(spark, d):
    """Passing pairs that lie at one insertion site, by their flanks."""
    e, n = elements(spark, d)
    return al.flank_matches(passed_pairs(e, n), e)


@query(f"with {PASSED}, {FLANKS} select i, j from passed anti join match using (i, j)")
def flank_filtered(spark, d):
    e, n = elements(spark, d)
    return al.flank_filter(passed_pairs(e, n), e).select("i", "j")


@query(f"with {INNER} select a.name as name_i, b.name as name_j, cast(ltr_ident as double) as ltr_ident, cast(int_ident as double) as int_ident from edges join el a on a.elem = i join el b on b.elem = j")
def similarity_edges(spark, d):
    """The edges of the similarity graph: repeats and internal parts both pass (flanks not filtered)."""
    e, n = elements(spark, d)
    edges = al.internal_edges(passed_pairs(e, n), e)
    return named(edges, e).select("name_i", "name_j", F.col("ltr_ident").cast("double").alias("ltr_ident"), F.col("int_ident").cast("double").alias("int_ident"))


GRAPH = f"""{PASSED.replace('passed as (', 'all_passed as (')}, {FLANKS.replace('from passed', 'from all_passed')}, passed as (select i, j, ltr_ident from all_passed anti join match using (i, j)), {INNER[len(PASSED) + 2:]},
pct as (select i, j, round_even((1 - cast(ltr_ident as double)) * 100, 1) as ltr_div_pct, round_even((1 - cast(int_ident as double)) * 100, 1) as int_div_pct from edges)"""
FAMILY = f"""{GRAPH}, s as (select i as a, j as b from pct union select j, i from pct), reach(node, other) as (select a, b from s union select reach.node, s.b from reach join s on reach.other = s.a),
comp as (select node, min(other) as component from reach group by node), big as (select component, row_number() over (order by component) as family from comp group by component having count(*) >= 3),
fam as (select family, node from comp join big using (component))"""


@query(f"with {GRAPH} select a.name as name_i, b.name as name_j, ltr_div_pct, int_div_pct from pct join el a on a.elem = i join el b on b.elem = j")
def family_edges(spark, d):
    """From records to the edges of the graph: repeats, flanks, internal parts, with divergences in percent."""
    e, n = elements(spark, d)
    return named(al.family_edges(e, n), e).select("name_i", "name_j", "ltr_div_pct", "int_div_pct")


def element_families_of(spark, d):
    e, n = elements(spark, d)
    edges, _ = materialize(al.family_edges(e, n))
    return e, edges, graph.families(edges, "i", "j")


@query(f"with recursive {FAMILY} select family, name as member from fam join el on elem = node")
def element_families(spark, d):
    """From records to families: components of three elements or more, numbered by their first element."""
    e, _, found = element_families_of(spark, d)
    return found.join(e.select(F.col("elem").alias("member"), "name"), "member").select("family", F.col("name").alias("member"))


@query()
def element_consensi(spark, d):
    """From records to consensi in one plan: edges, families, and a consensus of whole elements for each."""
    e, edges, found = element_families_of(spark, d)
    both = found.join(e.select(F.col("elem").alias("member"), F.col("full_seq").alias("seq")), "member")
    both, _ = materialize(both)
    known = both.where("seq <> ''").select("family", "member")
    heads = graph.centroids(known, graph.degrees(edges, "i", "j"))
    return star_consensus(both.join(heads.select("family", "centroid"), "family", "left"))


#: elements of one consensus as copies at the insertion site of its first member, every second one on the other strand
SITES = """held0 as (select distinct consensus, member from members where consensus is not null and member is not null),
head as (select consensus, flank_l as hl, flank_r as hr from (select consensus, min(member) as first from held0 join r on r.name = member where length(flank_l) >= 50 and length(flank_r) >= 50 group by consensus) join r on r.name = first),
moved as (select r.name, case when hl is null then flank_l when length(ltr5) % 2 = 0 then hl else reverse(translate(hr, 'ACGTacgt', 'TGCAtgca')) end as flank_l, case when hl is null then flank_r when length(ltr5) % 2 = 0 then hr else reverse(translate(hl, 'ACGTacgt', 'TGCAtgca')) end as flank_r
from r left join (select member, any_value(hl) as hl, any_value(hr) as hr from held0 join head using (consensus) group by member) h on h.member = r.name)"""


@query(f"with {PASSED}, {SITES}, {FLANKS.replace('from el where', 'from (select elem, moved.flank_l, moved.flank_r from el join moved using (name)) where')} select i, j from match")
def site_copies(spark, d):
    """Passing pairs at one insertion site, where the members of a consensus carry the flanks of its first member, as copies
    of one site in several genomes do, every second one on the other strand."""
    e, n = elements(spark, d)
    held = table(spark, d, "members").where("consensus is not null and member is not null").select("consensus", F.col("member").alias("name")).distinct()
    long_ = e.where("length(flank_l) >= 50 and length(flank_r) >= 50").select("name", "flank_l", "flank_r")
    first = held.join(long_, "name").groupBy("consensus").agg(F.min(F.struct("name", F.col("flank_l").alias("hl"), F.col("flank_r").alias("hr"))).alias("x")).select("consensus", "x.hl", "x.hr")
    moved = held.join(first, "consensus").groupBy("name").agg(F.any_value("hl").alias("hl"), F.any_value("hr").alias("hr"))
    even = F.length("ltr5") % 2 == 0
    place = lambda own, same, other: F.when(F.col("hl").isNull(), F.col(own)).when(even, F.col(same)).otherwise(reverse_complement(F.col(other))).alias(own)
    placed = e.join(moved, "name", "left").select("elem", place("flank_l", "hl", "hr"), place("flank_r", "hr", "hl"))
    return al.flank_matches(passed_pairs(e, n), placed)


@query("""with {records}, w as (select name, full_seq as s, unnest(range(1, length(full_seq) - 10)) as i from r where length(full_seq) >= 12),
x as (select name, i - 1 as loc, substr(s, i, 12) as w from w), y as (select *, lead(loc) over (partition by name, w order by loc) - loc as far from x where regexp_full_match(w, '[ACGT]{12}'))
select name, far // 64 as diagonal, count(*) as n_words, min(loc) as first_pos, max(loc) as last_pos from y where far between 200 and 30000 group by 1, 2 having count(*) >= 10""")
def repeat_diagonals(spark, d):
    """Two similar copies within one element, by the distance at which its words recur."""
    e, _ = elements(spark, d)
    return seeds.repeat_diagonals(e, "elem", "full_seq").join(e.select(F.col("elem").alias("id"), "name"), "id").drop("id")


def _recurring(spark, d, **how):
    e, _ = elements(spark, d)
    return seeds.repeat_diagonals(e, "elem", "full_seq", **how).join(e.select(F.col("elem").alias("id"), "name"), "id").drop("id")


RECUR = """{records}, w as (select name, full_seq as s, unnest(range(1, length(full_seq) - 10)) as i from r where length(full_seq) >= 12),
x as (select name, i - 1 as loc, substr(s, i, 12) as w from w), v as (select name, loc, w, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as c from x where regexp_full_match(w, '[ACGT]{12}'))"""


@query(f"""with {RECUR}, y as (select *, lead(loc) over (partition by name, w order by loc) - loc as far from v)
select name, far // 4 as diagonal, count(*) as n_words, min(loc) as first_pos, max(loc) as last_pos from y where far between 2 and 199 group by 1, 2 having count(*) >= 5""")
def tandem_arrays(spark, d):
    """Words that recur at a short distance, by the length of the unit."""
    return _recurring(spark, d, least=2, most=199, width=4, hits=5)


@query(f"""with {RECUR}, y as (select *, lead(loc) over g as nxt, lead(w = c) over g <> (w = c) as turned from v window g as (partition by name, c order by loc))
select name, (loc + nxt) // 64 as diagonal, count(*) as n_words, min(loc) as first_pos, max(loc) as last_pos from y where turned and nxt - loc between 50 and 30000 group by 1, 2 having count(*) >= 2""")
def inverted_repeats(spark, d):
    """Copies on the other strand of one element, by the sum of both positions."""
    return _recurring(spark, d, least=50, hits=2, inverted=True)


def over_sql(least: int) -> str:
    """The next occurrence of a word at ``least`` bases or more, as an as-of join."""
    return f"y as (select v.name, v.loc, u.loc - v.loc as far from v asof join v u on v.name = u.name and v.w = u.w and v.loc + {least} <= u.loc)"


@query(f"""with {RECUR}, {over_sql(200)}
select name, far // 64 as diagonal, count(*) as n_words, min(loc) as first_pos, max(loc) as last_pos from y where far <= 30000 group by 1, 2 having count(*) >= 10""")
def distant_repeats(spark, d):
    """Two similar copies within one element, also where their words recur nearby as well."""
    return _recurring(spark, d, over=True)


@query(f"""with {RECUR}, t as (select *, w = c as fwd from v), y as (select v.name, v.loc, u.loc as nxt from t v asof join t u on v.name = u.name and v.c = u.c and (not v.fwd) = u.fwd and v.loc + 50 <= u.loc)
select name, (loc + nxt) // 64 as diagonal, count(*) as n_words, min(loc) as first_pos, max(loc) as last_pos from y where nxt - loc <= 30000 group by 1, 2 having count(*) >= 2""")
def distant_inverted_repeats(spark, d):
    """Copies on the other strand of one element, also where their words recur nearby as well."""
    return _recurring(spark, d, least=50, hits=2, inverted=True, over=True)
