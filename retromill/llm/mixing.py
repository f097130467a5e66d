"""Mixing sources to target weights (problem 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retromill.shared import materialize

#: buckets into which a range of hashes is split at a time: 2^8
DIGIT = 8
HASH_BITS = 56


def source_name(c: Column) -> Column:
    """One spelling for a source: lower case, no blanks around, blanks and dashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def budgets(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens to take of each source: the largest total at which every source that has any reaches
    its share within its repeats. The share of a source without tokens goes to the others in
    proportion."""
    live = {s: (share, most) for s, (share, most) in targets.items() if tokens.get(s, 0) > 0 and share > 0 and most > 0}
    whole = sum(share for share, _ in live.values())
    if not live:
        return {}
    total = min(most * tokens[s] * whole / share for s, (share, most) in live.items())
    return {s: min(most * tokens[s], int(total * share / whole)) for s, (share, most) in live.items()}


def mix(sizes: DataFrame, item: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``item``, ``source``, ``n_tokens``, ``repeats`` for each item that is used, and
    ``source``, ``target_share``, ``actual_share``, ``n_tokens`` (used, repeats included),
    ``most_repeats`` for each target. ``sizes`` has ``item``, ``source`` and ``n_tokens``.

    Each source gets whole repeats and, for the rest of its budget, its items below a threshold of
    their hash. Hash-threshold histograms find it without sorting: tokens are summed by source and
    256 hash buckets, the bucket in which the budget ends is split into 256 again, and so on until
    it holds one item or none that fits. The driver sees at most 256 sums for each source in a
    level, and thresholds of a smaller budget lie within those of a larger one, so mixtures nest.

    Null sources, and sources without a target, are in no mixture. Items of no size are left out.
    Repeated target rows of one source count once (the smallest share and repeats). A null share
    or number of repeats is 0. Empty tables give empty mixtures; targets without items have an
    actual share of 0.
    """
    spark = sizes.sparkSession
    names = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source"))
    wanted, _ = materialize(names.agg(F.min(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(0))).cast("int").alias("max_repeats")))
    held = sizes.withColumn("source", source_name(F.col("source"))).where("n_tokens > 0").join(wanted.select("source"), "source", "left_semi")
    hashed, _ = materialize(held.select(item, "source", "n_tokens", F.shiftrightunsigned(F.xxhash64(item), 64 - HASH_BITS).alias("h")))
    target = {r.source: (r.target_share, r.max_repeats) for r in wanted.collect()}
    level = hashed.groupBy("source", F.shiftright("h", HASH_BITS - DIGIT).alias("bucket")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c")).collect()
    tokens: dict[str, int] = {}
    for r in level:
        tokens[r.source] = tokens.get(r.source, 0) + r.t
    take = budgets(tokens, target)
    whole = {s: min(b // tokens[s], target[s][1]) for s, b in take.items()}
    rest = {s: b - whole[s] * tokens[s] for s, b in take.items()}
    low = dict.fromkeys(take, 0)  # items with a smaller hash are in
    open_ = set(take)
    for shift in range(HASH_BITS - DIGIT, -1, -DIGIT):
        sums: dict[str, dict[int, tuple[int, int]]] = {s: {} for s in open_}
        for r in level:
            if r.source in open_:
                sums[r.source][r.bucket] = (r.t, r.c)
        for s in list(open_):
            bucket = low[s] >> shift
            for b in range(bucket, bucket + (1 << DIGIT)):
                t, c = sums[s].get(b, (0, 0))
                if t > rest[s]:
                    low[s] = b << shift
                    if c == 1:
                        open_.discard(s)
                    break
                rest[s] -= t
                low[s] = (b + 1) << shift
            else:
                open_.discard(s)
        if not open_ or not shift:
            break
        edge = " or ".join(f"(source = '{s.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}' and h >= {low[s]} and h < {low[s] + (1 << shift)})" for s in sorted(open_))
        level = hashed.where(edge).groupBy("source", F.shiftright("h", shift - DIGIT).alias("bucket")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c")).collect()
    lines = spark.createDataFrame([(s, whole[s], low[s]) for s in take], "source string, whole int, low long")
    used = hashed.join(F.broadcast(lines), "source").withColumn("repeats", F.col("whole") + (F.col("h") < F.col("low")).cast("int")).where("repeats > 0")
    used = used.select(item, "source", "n_tokens", "repeats")
    reached = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    total = reached.agg(F.sum("n_tokens").alias("all_tokens"))
    report = wanted.join(reached, "source", "left").join(F.broadcast(total)).select(
        "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats")
    )
    return used, report
