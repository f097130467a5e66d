"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retromill.llm.components import linked_records
from retromill.llm.mixing import mix
from retromill.llm.neardup import similar_pairs
from retromill.llm.packing import pack
from retromill.llm.spans import shared_spans
from retromill.llm.subjects import subject_areas
from retromill.llm.terms import term_frequencies
from retromill.llm.tokens import count_tokens
from retromill.shared import table

#: the session setting that names the file of the vocabulary, and where it is if the session does not say
VOCABULARY = ("spark.retromill.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
with recursive r as (select distinct name from ltr_records where name is not null),
e as (select distinct name_a as a, name_b as b from match_pairs where name_a <> name_b and name_a in (from r) and name_b in (from r)),
s as (select a, b from e union select b, a from e),
reach(name, other) as (select a, b from s union select reach.name, s.b from reach join s on reach.other = s.a)
select min(other) as group_name, name from reach group by name
""")
def p1_found(spark, d):
    return linked_records(table(spark, d, "match_pairs"), table(spark, d, "ltr_records"))


@query("""
with r as (select name, upper(coalesce(ltr5, '')) as a, upper(coalesce(internal, '')) as b, upper(coalesce(ltr3, '')) as c from (
  select *, row_number() over (partition by name order by loaded_at desc) as n from ltr_records where name is not null) where n = 1),
f as (select name, 'ltr5' as field, a as s from r union all select name, 'internal', b from r),
w as (select name, field, i, substr(s, i, 80) as w from (select *, unnest(range(1, length(s) - 78)) as i from f where length(s) >= 80)),
v as (select * from w where regexp_full_match(w, '[ACGT]{80}')),
h as (select name, field, i, lead(i) over (partition by name, field order by i) as nxt from v where w in (select w from v group by w having count(distinct name) > 1))
select name, field, cast(sum(least(80, coalesce(nxt - i, 80))) as bigint) as shared_len from h group by name, field
""")
def p2_found(spark, d):
    return shared_spans(table(spark, d, "ltr_records"))


@query("""
with r as (select name, upper(coalesce(ltr5, '')) as a, upper(coalesce(internal, '')) as b, upper(coalesce(ltr3, '')) as c from (
  select *, row_number() over (partition by name order by loaded_at desc) as n from ltr_records where name is not null) where n = 1),
f as (select name, a as s from r union all select name, b from r union all select name, c from r),
w as (select name, substr(s, i, 12) as w from (select *, unnest(range(1, length(s) - 10)) as i from f where length(s) >= 12)),
k as (select distinct name, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) as word from w where regexp_full_match(w, '[ACGT]{12}')),
n as (select name, count(*) as n from k group by name),
c as (select a.name as name_a, b.name as name_b, count(*) as common from k a join k b using (word) where a.name < b.name group by 1, 2)
select name_a, name_b from c join n x on x.name = name_a join n y on y.name = name_b where 2 * common >= x.n + y.n - common
""")
def p3_found(spark, d):
    return similar_pairs(table(spark, d, "ltr_records"))


@query("""
with r as (select name, upper(coalesce(ltr5, '')) as a, upper(coalesce(internal, '')) as b from (
  select *, row_number() over (partition by name order by loaded_at desc) as n from ltr_records where name is not null) where n = 1),
f as (select name, a as s from r union all select name, b from r),
w as (select name, substr(s, i, 10) as term from (select name, s, unnest(range(1, length(s) - 8)) as i from f where length(s) >= 10)),
t as (select term, count(*) as n_occ, count(distinct name) as n_records from w where regexp_full_match(term, '[ACGT]{10}') group by term)
select term, n_occ, n_records, case when n_records = 1 then 'rare' when n_records > 0.02 * (select count(*) from r) then 'common' else 'usable' end as mark from t
""")
def p6_found(spark, d):
    return term_frequencies(table(spark, d, "ltr_records"))


def _sizes(spark, d, *keep):
    return count_tokens(table(spark, d, "documents"), *keep, vocabulary=spark.conf.get(*VOCABULARY))


@query()
def p7_containers(spark, d):
    return pack(_sizes(spark, d, "doc_id"), "doc_id", "n_tokens")


def _mixture(spark, d):
    return mix(_sizes(spark, d, "doc_id", "source"), "doc_id", table(spark, d, "mix_targets"))


@query()
def p8_mixture(spark, d):
    return _mixture(spark, d)[0]


@query()
def p8_shares(spark, d):
    return _mixture(spark, d)[1]


def _subjects(spark, d):
    return subject_areas(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


@query()
def p9_found(spark, d):
    return _subjects(spark, d)


@query()
def p9_composition(spark, d):
    """Documents of each subject and of none, with their shares of the corpus."""
    found = _subjects(spark, d).groupBy("doc_id").agg(F.collect_set("subject").alias("s"))
    every = table(spark, d, "documents").select("doc_id").join(found, "doc_id", "left")
    each = every.select(F.explode(F.coalesce("s", F.array(F.lit("none")))).alias("subject"), (1 / F.coalesce(F.size("s"), F.lit(1))).alias("part"))
    counted = each.groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("part").alias("parts"))
    total = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(total)).select("subject", "n_documents", F.round(F.col("parts") / F.col("n"), 6).alias("share"))
