"""The queries of the two general problems."""

from __future__ import annotations

from retromill.operators.periods import periods_and_gaps
from retromill.operators.skew import eager_counts
from retromill.queries.registry import query
from retromill.shared import table


@query("""
with h as (select hit_id, any_value(name) as name, any_value(partner) as partner from seed_hits group by hit_id),
held as (select distinct m.member, c.num_sequences from members m join consensi c on m.consensus = c.name where c.num_sequences is not null)
select 'name' as key_kind, name as key_name, count(*) as n_rows, count(distinct partner) as n_partners from h where name is not null group by name
union all
select 'num_sequences', cast(num_sequences as varchar), count(*), count(distinct partner) from h join held on h.partner = held.member group by num_sequences
""")
def p4_found(spark, d):
    return eager_counts(table(spark, d, "seed_hits"), table(spark, d, "members"), table(spark, d, "consensi"))


@query("""
with i as (select distinct scaffold_idx, r1s as s, r2e as e from ltr_aligns where scaffold_idx is not null and r1s < r2e),
b as (select *, max(e) over (partition by scaffold_idx order by s, e rows between unbounded preceding and 1 preceding) as before from i),
g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by scaffold_idx order by s, e rows unbounded preceding) as island from b),
p as (select scaffold_idx, island, min(s) as seg_start, max(e) as seg_end from g group by scaffold_idx, island)
select 'period' as kind, cast(scaffold_idx as bigint) as scaffold_idx, seg_start, seg_end from p
union all
select 'gap', cast(scaffold_idx as bigint), seg_end, nxt from (select *, lead(seg_start) over (partition by scaffold_idx order by seg_start) as nxt from p) where nxt is not null
""")
def p5_found(spark, d):
    found = periods_and_gaps(table(spark, d, "ltr_aligns"), "scaffold_idx", "r1s", "r2e")
    return found.withColumnRenamed("entity", "scaffold_idx")
