"""The round loop: detect, cluster, collapse, scan again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retromill.operators.classes import is_ltr
from retromill.operators.coordinates import lift_through, overlapping, scan_windows, with_shifts
from retromill.operators.graph import families
from retromill.operators.periods import merge_events, periods_and_gaps
from retromill.shared import materialize


def round_bed(detections: DataFrame) -> DataFrame:
    """``seq_index``, ``start``, ``end``, ``name`` (with the round before it), ``round``."""
    return detections.select(F.col("scaffold_idx").cast("long").alias("seq_index"), F.col("r1s").alias("start"), F.col("r2e").alias("end"), F.concat(F.lit("r"), F.col("round").cast("string"), F.lit("_"), "element").alias("name"), "round")


def reconcile(new: DataFrame, old: DataFrame) -> DataFrame:
    """``id``, ``reused``: each new detection with the old node of the same ``key`` that it takes over, or
    null; the first takes the first, the second the second, so no node is taken twice. A key holds
    the few detections at one place."""
    k = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    a, b = new.withColumn("k", k), old.withColumn("k", k).select("key", "k", F.col("id").alias("reused"))
    same = [F.col("a.key").eqNullSafe(F.col("b.key")), F.col("a.k") == F.col("b.k")]
    return a.alias("a").join(b.alias("b"), same, "left").select("a.id", "b.reused")


def reconcile_nodes(new: DataFrame, old: DataFrame, removed: DataFrame) -> DataFrame:
    """``id``, ``reused``: each detection of ``new`` (``id``, ``entity``, ``start``, ``end``, ``seq``, footprint ``fs`` to
    ``fe``) with the node of ``old`` at the same place and with the same sequence that it takes over, or null. One whose
    footprint overlaps what was ``removed`` (``entity``, ``orig_start``, ``orig_end``) is new in any case. Sequences are
    compared by their digests; a null one is empty."""
    key = F.struct("entity", "start", "end", F.sha2(F.coalesce("seq", F.lit("")), 256).alias("seq")).alias("key")
    hit = overlapping(new.select("id", "entity", "fs", "fe"), removed, "entity", "fs", "fe", "orig_start", "orig_end").select("id")
    same = reconcile(new.join(hit, "id", "left_anti").select(key, "id"), old.select(key, "id"))
    return same.unionByName(hit.select("id", F.lit(None).cast(same.schema["reused"].dataType).alias("reused")))


def to_collapse(members: DataFrame, classes: DataFrame, places: DataFrame) -> DataFrame:
    """``member``, ``entity``, ``orig_start``, ``orig_end``: what a round takes out: its own detections (``places``, with
    ``member``, ``entity``, ``start``, ``end``) that are members of a family classified as LTR."""
    ltr = classes.where(is_ltr(F.col("class"))).select("consensus").distinct()
    some = members.select("consensus", "member").distinct().join(ltr, "consensus", "left_semi").select("member").distinct()
    return places.join(some, "member", "left_semi").select("member", "entity", F.col("start").alias("orig_start"), F.col("end").alias("orig_end"))


def round_stats(placed: DataFrame, scaffolds: DataFrame) -> DataFrame:
    """``round``, ``n_elements``, ``covered``, ``permyriad`` (of all scaffolds) from ``round``, ``entity``
    (round and scaffold in one number), ``r1s``, ``r2e``."""
    n = placed.groupBy("round").agg(F.count(F.lit(1)).alias("n_elements"))
    cover = periods_and_gaps(placed, "entity", "r1s", "r2e").where("kind = 'period'")
    cover = cover.groupBy(F.shiftright("entity", 32).cast("int").alias("round")).agg(F.sum(F.col("seg_end") - F.col("seg_start")).alias("covered"))
    total = scaffolds.agg(F.sum("scaf_len").alias("total"))
    both = n.join(cover, "round").join(F.broadcast(total))
    return both.select("round", "n_elements", "covered", F.bround(F.col("covered") * 10000 / F.col("total"), 0).cast("long").alias("permyriad"))


def scan_stats(placed: DataFrame, scaffolds: DataFrame, flank: int = 32_768) -> DataFrame:
    """How each round of scans shortens the sequences: ``round``, ``n_events``, ``removed``, ``before`` and ``after`` (bases),
    ``round_permyriad`` and ``total_permyriad`` taken out, ``active_bp`` (windows around what the round before took out; all
    in the first) and ``skipped_bp``. ``placed`` has ``round``, ``entity`` (round and scaffold in one number), ``orig_start``,
    ``orig_end``, ``unit_len``. Only the totals of rounds, a few rows, meet in one task."""
    of = F.shiftright("entity", 32).cast("int").alias("round")
    n = placed.groupBy("round").agg(F.count(F.lit(1)).alias("n_events"))
    taken = with_shifts(placed.drop("round")).groupBy(of).agg(F.sum("removed").alias("removed"))
    known = placed.select("round", "entity").distinct().withColumn("seq_index", F.col("entity").bitwiseAND(F.lit(2**32 - 1)))
    lengths = known.join(scaffolds.select("seq_index", F.col("scaf_len").alias("len")), "seq_index").select("entity", "len")
    windows = scan_windows(placed.select("entity", "orig_start", "orig_end"), lengths, flank).groupBy(of).agg(F.sum(F.col("win_end") - F.col("win_start")).alias("window"))
    total = scaffolds.agg(F.sum("scaf_len").alias("total"))
    w = Window.orderBy("round")
    both = n.join(taken, "round").join(windows, "round", "left").join(F.broadcast(total))
    both = both.withColumn("after", F.col("total") - F.sum("removed").over(w)).withColumn("before", F.col("after") + F.col("removed"))
    both = both.withColumn("active_bp", F.when(F.row_number().over(w) == 1, F.col("total")).otherwise(F.coalesce(F.lag("window").over(w), F.lit(0))))
    share = lambda part, of: F.bround(part * 10000 / of, 0).cast("long")
    return both.select("round", "n_events", "removed", "before", "after", share(F.col("removed"), F.col("before")).alias("round_permyriad"), share(F.col("total") - F.col("after"), F.col("total")).alias("total_permyriad"), "active_bp", (F.col("total") - F.col("active_bp")).alias("skipped_bp"))


def run_rounds(detect: Callable[[list[DataFrame], int], DataFrame], link: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], most: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """Scan, cluster and collapse until nothing is left to take out: the families of the last round and
    the maps of all rounds.

    ``detect(layers, round)`` gives the detections (``name``, ``entity``, ``start``, ``end``) in the
    coordinates left by the maps so far; ``link(nodes)`` the edges (``a``, ``b``) among all nodes;
    ``keep(families)`` the members of families that may be taken out. Detections of earlier rounds
    stay as evidence. Each round's nodes and map are written to the shared folder."""
    layers: list[DataFrame] = []
    nodes = found = None
    for round_ in range(1, most + 1):
        new = detect(layers, round_).withColumn("round", F.lit(round_)).withColumn("name", F.concat(F.lit(f"r{round_}_"), "name"))
        nodes, _ = materialize(new if nodes is None else nodes.unionByName(new))
        found, _ = materialize(families(link(nodes), "a", "b"))
        out = keep(found).select("member").join(nodes.where(F.col("round") == round_), F.col("member") == F.col("name"))
        spec, facts = materialize(merge_events(out.withColumn("unit", F.lit(0)), "entity", "start", "end", "unit"), F.count(F.lit(1)).alias("n"))
        if round_ == most or not facts["n"]:
            break
        layers.append(spec)
    return found, layers


def original_positions(detections: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """Detections with ``start`` and ``end`` lifted through all maps to the original sequences."""
    for c in ("start", "end"):
        detections = lift_through(detections, layers, c).withColumn(c, F.col("lifted")).drop("lifted")
    return detections


def affected(detections: DataFrame, removed: DataFrame) -> DataFrame:
    """Detections whose footprint overlaps what the last round took out."""
    return overlapping(detections, removed, "entity", "start", "end", "orig_start", "orig_end")
