"""Statistics of sequence collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_stats(rows: DataFrame, seq: str) -> DataFrame:
    """One row: ``n_seqs``, ``total_len``, ``avg_len`` (two digits), ``min_len``, ``max_len``. Null
    sequences are no sequences; of none the counts are 0 and the rest null."""
    n = F.length(seq)
    return rows.where(F.col(seq).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_seqs"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_len"),
        F.round(F.avg(n), 2).alias("avg_len"),
        F.min(n).cast("long").alias("min_len"),
        F.max(n).cast("long").alias("max_len"),
    )


def base_composition(rows: DataFrame, seq: str) -> DataFrame:
    """``base``, ``n``: how often each letter occurs, in lower case. One pass counts the four bases,
    n and all others without splitting the strings. Null sequences count nothing."""
    s = F.lower(seq)
    counts = [(b, F.coalesce(F.sum(F.length(s) - F.length(F.translate(s, b, ""))), F.lit(0))) for b in "acgnt"]
    other = F.coalesce(F.sum(F.length(F.translate(s, "acgnt", ""))), F.lit(0))
    one = rows.agg(*(c.cast("long").alias(b) for b, c in counts), other.cast("long").alias("other"))
    return one.select(F.expr("stack(6, 'a', a, 'c', c, 'g', g, 'n', n, 't', t, 'other', other) as (base, n)"))


def length_quantile(rows: DataFrame, seq: str, share: float = 0.5) -> DataFrame:
    """One row, ``n50``: the greatest length such that sequences at least as long hold ``share`` of all
    letters. Only the number of sequences of each length is cumulated, never the sequences."""
    lens = rows.where(F.col(seq).isNotNull()).groupBy(F.length(seq).cast("long").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    lens = lens.withColumn("letters", F.col("len") * F.col("c"))
    total = lens.agg(F.sum("letters").alias("total"))
    run = lens.withColumn("above", F.sum("letters").over(Window.orderBy(F.desc("len"))))
    return run.join(F.broadcast(total)).where(F.col("above") >= F.col("total") * share).agg(F.max("len").alias("n50"))


def length_histogram(rows: DataFrame, seq: str) -> DataFrame:
    """``bin``, ``from_len``, ``n_seqs``: lengths in bins that widen with the square of their number,
    bin b beginning at b * b."""
    b = F.floor(F.sqrt(F.length(seq).cast("double"))).cast("long")
    counted = rows.where(F.col(seq).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n_seqs"))
    return counted.select("bin", (F.col("bin") * F.col("bin")).alias("from_len"), "n_seqs")


def subsequences(sequences: DataFrame, requests: DataFrame) -> DataFrame:
    """``request``, ``part``: for each distinct ``request`` as 'name:start-end' (counted from 0, half-open) that stretch of the
    sequence, in lower case, cut where it ends. Names may hold colons. A request that is not of this form
    or whose sequence is not there has a null. ``sequences`` has ``name`` (once each) and ``seq``."""
    form = r"^(.*):(\d+)-(\d+)$"
    r = requests.select("request").where("request is not null").distinct()
    r = r.select("request", *(F.regexp_extract("request", form, k).alias(c) for k, c in enumerate(("name", "s", "e"), 1)))
    r = r.select("request", F.when(F.col("s") != "", F.col("name")).alias("name"), *(F.expr(f"try_cast({c} as bigint)").alias(c) for c in "se"))
    # positions beyond the end of any string are all the same
    cut = F.least("s", F.lit(1 << 30)), F.least("e", F.lit(1 << 30))
    part = F.lower(F.substring("seq", (cut[0] + 1).cast("int"), F.greatest(cut[1] - cut[0], F.lit(0)).cast("int")))
    return r.join(sequences.select("name", "seq"), "name", "left").select("request", part.alias("part"))
