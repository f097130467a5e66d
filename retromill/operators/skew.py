"""Counts per key where a few keys hold most rows (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retromill.shared import materialize


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One row for each ``hit_id``, by partial aggregation; where repeated rows differ, the one with
    the greatest (found_at, name, partner). A null ``hit_id`` identifies nothing: such rows are kept
    one by one."""
    some = hits.where("hit_id is not null").groupBy("hit_id").agg(F.max(F.struct("found_at", "name", "partner")).alias("x"))
    return some.select("x.name", "x.partner").unionByName(hits.where("hit_id is null").select("name", "partner"))


def eager_counts(hits: DataFrame, members: DataFrame, consensi: DataFrame) -> DataFrame:
    """Hits and distinct partners for each library element and each value of ``num_sequences``.

    Eager aggregation: the hits are first reduced to one compact state (name, partner, number of
    hits), for which the shuffle is on both columns, so that the hits of a hot name spread over its
    partners. The states are written once. Both results come from these states by sums: within a name each partner is one state,
    so distinct partners are counted without keeping them. For ``num_sequences`` the states are
    reduced to one row for each partner *before* the join; the other side is one row for each
    (member, value), so the join multiplies nothing and its counts add up. All later groupings
    have partial sums; no task gets the rows of a hot key.

    Null partners count as hits but not as partners; null names have no ``name`` row; members of no
    consensus, of one without ``num_sequences`` or with a null name count for no value. A partner in
    two consensi of one value counts once for it, in two of different values for each. Empty tables
    give no rows.
    """
    states, _ = materialize(distinct_hits(hits).groupBy("name", "partner").agg(F.count(F.lit(1)).alias("n")))
    per_name = (
        states.where("name is not null")
        .groupBy(F.col("name").alias("key_name"))
        .agg(F.sum("n").alias("n_rows"), F.count("partner").alias("n_partners"))
        .select(F.lit("name").alias("key_kind"), "key_name", "n_rows", "n_partners")
    )
    per_partner = states.where("partner is not null").groupBy(F.col("partner").alias("member")).agg(F.sum("n").alias("n"))
    values = consensi.where("name is not null and num_sequences is not null").select(F.col("name").alias("consensus"), "num_sequences").distinct()
    held = members.where("member is not null").select("consensus", "member").distinct().join(values, "consensus").select("member", "num_sequences").distinct()
    per_value = (
        per_partner.join(held, "member")
        .groupBy("num_sequences")
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_partners"))
        .select(F.lit("num_sequences").alias("key_kind"), F.col("num_sequences").cast("string").alias("key_name"), "n_rows", "n_partners")
    )
    return per_name.unionByName(per_value)
