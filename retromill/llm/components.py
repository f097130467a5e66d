"""Consolidating pairwise matches into groups (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retromill.operators.coordinates import number_rows
from retromill.shared import discard, join_hot_keys, materialize


def hash_to_min(pairs: DataFrame, a: str, b: str, names: DataFrame | None = None, most_rounds: int = 100) -> DataFrame:
    """Connected components by hash-to-min: ``name`` and ``group_name``, the smallest name that it
    is linked to directly or through others, for each name with at least one link to another. With ``names``
    (a column ``name``) only pairs of which both names are in it link.

    Names are numbered once in their order, so that all rounds send numbers, of which the smallest stands for
    the smallest name. Each vertex holds a cluster, at first itself and its neighbours, kept as rows (vertex,
    member). In each round it sends its whole cluster to the smallest member and the smallest member to all
    others, until no cluster changes: then each is either a single smallest member or the whole group. The smallest
    vertex of a large group holds many rows, so clusters stay rows, never lists, and
    :func:`join_hot_keys` keeps the rows of large groups out of the shuffle. Each round is written
    to the shared folder.

    Pairs with a null and pairs of a name with itself link nothing; repeated pairs and pairs in
    either order are one link; no pairs give no rows.
    """
    spark = pairs.sparkSession
    links = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null and v <> u")
    if names is None:
        names = links.select(F.explode(F.array("v", "u")).alias("name"))
    ids = number_rows(names.where("name is not null").select("name").distinct(), "name", name="id")
    for c in "vu":
        links = links.join(ids.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")), c)
    links = links.select(F.col("v_id").alias("v"), F.col("u_id").alias("u"))
    # both tell whether a round changed anything
    facts = (F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0)).alias("sum"))
    own = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    both = links.select(F.explode(F.array(own("v", "v"), own("v", "u"), own("u", "u"), own("u", "v"))).alias("x")).select("x.*")
    cluster, seen = materialize(both.distinct(), *facts)
    for _ in range(most_rounds):
        least = cluster.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        sent = join_hot_keys(cluster, least, "v", "n", seen["n"])
        after, now = materialize(sent.select(F.explode(F.array(own("m", "u"), own("u", "m"))).alias("x")).select("x.*").distinct(), *facts)
        discard(spark, seen["path"])
        done = (now["n"], now["sum"]) == (seen["n"], seen["sum"])
        cluster, seen = after, now
        if done:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    groups, total = materialize(cluster.groupBy("v").agg(F.min("u").alias("m")), F.count(F.lit(1)).alias("n"))
    discard(spark, seen["path"])
    size = groups.groupBy("m").agg(F.count(F.lit(1)).alias("size")).join(ids.select(F.col("id").alias("m"), F.col("name").alias("group_name")), "m")
    named = join_hot_keys(groups, size, "m", "size", total["n"])
    return named.join(ids.select(F.col("id").alias("v"), "name"), "v").select("group_name", "name")


def linked_records(match_pairs: DataFrame, ltr_records: DataFrame) -> DataFrame:
    """Groups of records by ``match_pairs``; a pair counts if both of its names are records."""
    pairs = match_pairs.select("name_a", "name_b").where("name_a is not null and name_b is not null and name_a <> name_b").distinct()
    return hash_to_min(pairs, "name_a", "name_b", ltr_records.select("name"))
