"""The similarity graph: components, families, centroids, incremental edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retromill.operators.coordinates import number_rows
from retromill.shared import FEW, discard, join_hot_keys, materialize


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node it is connected to): large-star and small-star steps in
    turn until nothing changes. In the first every node hangs its greater neighbours on the smallest
    node it knows, in the second its smaller ones. Steps are written to the shared folder, and nodes
    with very many neighbours are joined by broadcast. Self-edges and nulls connect nothing."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v and " + f"{a} is not null and {b} is not null").distinct()
    e, facts = materialize(e, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("sum"))

    def star(rows: DataFrame, total: int) -> DataFrame:
        if total <= FEW:  # no key can be hot, so the rows of each meet in one task
            return rows.withColumn("m", F.least(F.min("v").over(Window.partitionBy("u")), F.col("u")))
        low = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("deg"))
        low, seen = materialize(low)
        used.append(seen["path"])
        return join_hot_keys(rows, low, "u", "deg", total)

    for _ in range(most_rounds):
        used: list[str] = [facts["path"]]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, 2 * facts["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        most = facts["n"]  # an edge gives one at most
        if most > FEW:
            large, seen = materialize(large, F.count(F.lit(1)).alias("n"))
            used.append(seen["path"])
            most = seen["n"]
        small = star(large, most)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after, now = materialize(small, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("sum"))
        for path in used:
            discard(spark, path)
        same = (now["n"], now["sum"]) == (facts["n"], facts["sum"])
        e, facts = after, now
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def families(edges: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """``family``, ``member``: components of at least ``least`` nodes, numbered from 1 in the order of
    their smallest members."""
    c = components(edges, a, b)
    big = c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return c.join(number_rows(big.drop("n"), "component", name="family"), "component").select("family", F.col("node").alias("member"))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``degree``: distinct neighbours, for each node of an edge."""
    e = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    ends = e.select(F.explode(F.array("a", "b")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def centroids(family: DataFrame, degree: DataFrame) -> DataFrame:
    """``family``, ``centroid``, ``degree``: the member with most neighbours, the smallest name on a tie."""
    best = F.min(F.struct((-F.col("degree")).alias("less"), F.col("member").alias("centroid"))).alias("x")
    both = family.join(degree.withColumnRenamed("node", "member"), "member")
    return both.groupBy("family").agg(best).select("family", "x.centroid", (-F.col("x.less")).alias("degree"))


def new_pairs(pairs: DataFrame, a: str, b: str, new: DataFrame) -> DataFrame:
    """Pairs with at least one side among the ``name`` of ``new``."""
    n = new.select("name").distinct().withColumn("_new", F.lit(True))
    both = pairs.join(n.withColumnRenamed("name", a).withColumnRenamed("_new", "_na"), a, "left").join(n.withColumnRenamed("name", b).withColumnRenamed("_new", "_nb"), b, "left")
    return both.where("_na or _nb").drop("_na", "_nb")


def reused_edges(old: DataFrame, a: str, b: str, alive: DataFrame) -> DataFrame:
    """Edges of earlier rounds of which both ends still exist."""
    n = alive.select("name").distinct()
    return old.join(n.withColumnRenamed("name", a), a, "left_semi").join(n.withColumnRenamed("name", b), b, "left_semi")


def without_classes(nodes: DataFrame, edges: DataFrame, a: str, b: str, excluded: tuple[str, ...] = ("unassigned", "non-LTR")) -> DataFrame:
    """``node``, ``class``, ``component``: the nodes of components none of whose nodes has an ``excluded`` class. ``nodes`` has
    ``node`` (unique) and ``class``; null is 'unassigned'. A node without edges is a component of its own, an end of an edge that is no
    node has no class and so excludes its component. A component of any size is spread over the tasks."""
    known = nodes.where("node is not null").select("node", F.coalesce("class", F.lit("unassigned")).alias("class"))
    placed = known.join(components(edges, a, b), "node", "full").select("node", F.coalesce("class", F.lit("unassigned")).alias("class"), F.coalesce("component", "node").alias("component"))
    placed, facts = materialize(placed, F.count(F.lit(1)).alias("n"))
    kept = placed.groupBy("component").agg(F.max(F.col("class").isin(*excluded)).alias("_bad"), F.count(F.lit(1)).alias("_n")).where("not _bad")
    return join_hot_keys(placed, kept, "component", "_n", facts["n"]).select("node", "class", "component")


def gml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``line``, ``ord``: the graph as text, one block for each node and edge, nodes first; ``nodes`` has
    ``id``, ``label``, ``edges`` has ``source``, ``target`` and their percentages."""
    text = F.format_string('  node [\n    id %d\n    label "%s"\n  ]', "id", F.regexp_replace("label", "[-_.]", ""))
    link = F.format_string("  edge [\n    source %d\n    target %d\n    ltrdivergencepct %s\n    internaldivergencepct %s\n  ]", "source", "target", F.col("ltr_div_pct").cast("string"), F.col("int_div_pct").cast("string"))
    n = nodes.select(F.struct(F.lit(1).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"), text.alias("line"))
    e = edges.select(F.struct(F.lit(2).alias("k"), F.col("source").alias("a"), F.col("target").alias("b")).alias("ord"), link.alias("line"))
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, "graph ["), (3, "]")], "k int, line string").select(F.struct("k", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"), "line")
    return n.unionByName(e).unionByName(ends)


def subfamilies(edges: DataFrame, a: str, b: str, distance: str, family: DataFrame, cut: float = 0.2) -> DataFrame:
    """``family``, ``tag``, ``member``: within each family the groups of two members or more that edges of at most
    ``cut`` connect, lettered in the order of their smallest members; the tag is empty where a family
    has one such group. Edges with a null distance connect nothing."""
    from retromill.operators.consensus import subfamily_tag

    near = components(edges.where(F.col(distance) <= cut), a, b).withColumnRenamed("node", "member").join(family, "member")
    heads = near.select("family", "component").distinct()
    placed = number_rows(heads, "family", "component", name="at")  # no task gets all groups of a family
    first = placed.groupBy("family").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    ranked = placed.join(first, "family").select("family", "component", (F.col("at") - F.col("first")).alias("i"), "n")
    tagged = ranked.select("component", F.when(F.col("n") > 1, subfamily_tag(F.col("i"))).otherwise("").alias("tag"))
    return near.join(tagged, "component").select("family", "tag", "member")
