from retromill.operators.skew import eager_counts
from retromill.shared import join_hot_keys

HITS = "hit_id long, name string, partner string, found_at timestamp, consensus string"


def run(spark, hits, members, consensi):
    h = spark.createDataFrame(hits, HITS)
    m = spark.createDataFrame(members, "consensus string, member string, name string")
    c = spark.createDataFrame(consensi, "name string, num_sequences int, member string")
    return sorted(tuple(r) for r in eager_counts(h, m, c).collect())


def test_counts(spark):
    hits = [(1, "A", "x", None, None), (1, "A", "x", None, None), (2, "A", None, None, None), (3, "A", "x", None, None), (4, None, "x", None, None), (5, "B", "y", None, None), (None, "B", "y", None, None), (None, "B", "y", None, None)]
    members = [("c1", "x", None), ("c1", "x", None), ("c2", "y", None), (None, "x", None), ("c3", None, None), ("c9", "z", None)]
    consensi = [("c1", 3, None), ("c1", 3, None), ("c2", None, None), (None, 3, None), ("c3", 7, None)]
    assert run(spark, hits, members, consensi) == [("name", "A", 3, 1), ("name", "B", 3, 1), ("num_sequences", "3", 3, 1)]


def test_empty(spark):
    assert run(spark, [], [], []) == []


def test_hot_keys_are_joined_once(spark):
    rows = spark.range(30_000).selectExpr("case when id % 3 < 2 then 0 else id end as k", "id as v")
    side = rows.groupBy("k").count().withColumnRenamed("count", "n")
    got = join_hot_keys(rows, side, "k", "n", 30_000)
    assert got.count() == 30_000 and got.where("k = 0").count() == 20_000 and got.where("n <> 1").select("n").distinct().collect()[0][0] == 20_000
