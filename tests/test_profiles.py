"""Profiles, labels, runs and indels on small cases against plain Python."""

from pyspark.sql import functions as F

from retromill.config import Thresholds
from retromill.functions import dna, labels
from retromill.operators import consensus as cs
from retromill.operators import coordinates as co
from retromill.operators import graph, seeds

COUNTS = "family string, col long, a long, c long, g long, t long"


def counts(spark, *cells):
    return spark.createDataFrame(cells, COUNTS)


def plain(df):
    return sorted(tuple(r) for r in df.select("family", "col", "a", "c", "g", "t").collect())


def test_quick_consensus_breaks_ties_by_letter_and_has_no_codes(spark):
    c = counts(spark, ("f", 0, 2, 2, 0, 0), ("f", 1, 0, 0, 0, 0), ("f", 2, 0, 1, 1, 3), ("g", 0, 0, 0, 4, 4))
    assert {tuple(r) for r in cs.quick_consensus(c).collect()} == {("f", "ANT"), ("g", "G")}
    assert cs.quick_consensus(c.where("false")).count() == 0


def test_ambiguity_bar_counts_only_where_no_base_is_above_the_first(spark):
    c = counts(spark, ("f", 0, 35, 35, 15, 15), ("f", 1, 25, 25, 25, 25), ("f", 2, 90, 10, 0, 0), ("f", 3, 0, 0, 0, 0))
    n = spark.createDataFrame([("f", 100)], "family string, n long")
    letters = lambda t: cs.majority(c, n, t).first()["consensus"]
    assert letters(Thresholds()) == "NNA-"
    assert letters(Thresholds(ambiguity=0.3)) == "MNA-"
    assert letters(Thresholds(ambiguity=0.5)) == "NNA-"


def test_reversed_counts(spark):
    c = counts(spark, ("f", 0, 1, 2, 3, 4), ("f", 1, 5, 6, 7, 8))
    assert plain(cs.reversed_counts(c)) == [("f", 0, 8, 7, 6, 5), ("f", 1, 4, 3, 2, 1)]
    assert plain(cs.reversed_counts(cs.reversed_counts(c))) == plain(c)


def test_merged_counts_walk_the_alignment(spark):
    left = counts(spark, *(("f", i, i + 1, 0, 0, 0) for i in range(4)), ("g", 0, 1, 0, 0, 0), ("h", 0, 1, 0, 0, 0))
    right = counts(spark, *(("f", i, 0, i + 1, 0, 0) for i in range(3)), ("g", 0, 0, 1, 0, 0))
    aligned = spark.createDataFrame([("f", "1D2M1I1D"), ("g", "1M"), ("h", None)], "family string, cigar string")
    found = plain(cs.merged_counts(left, right, aligned))
    assert found == [("f", 0, 1, 0, 0, 0), ("f", 1, 2, 1, 0, 0), ("f", 2, 3, 2, 0, 0), ("f", 3, 0, 3, 0, 0), ("f", 4, 4, 0, 0, 0), ("g", 0, 1, 1, 0, 0)]
    beyond = aligned.select("family", F.lit("9M").alias("cigar")).where("family = 'f'")
    assert [r[1] for r in plain(cs.merged_counts(left, right, beyond))] == [0, 1, 2]


def test_runs_expand_to_what_was_compressed(spark):
    texts = ["", "A", "AAAA", "ACCGTTTTNNA", "A" * 100_000 + "C", "aA\n\nA", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    back = df.select("i", dna.homopolymer_expand(dna.homopolymer_compress(F.col("s")), dna.homopolymer_lengths(F.col("s"))).alias("x"))
    found = {r["i"]: r["x"] for r in back.collect()}
    assert [found[i] for i in range(len(texts)) if i != 5] == [t for i, t in enumerate(texts) if i != 5]


def test_labels_of_paths(spark):
    paths = ["/d/idAno-1_2.pri.fa.gz", "x.alt.1.fa/", "plain", "a.pri", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    found = [tuple(r) for r in df.select(labels.genome_label(F.col("p")), labels.haplotype_tag(F.col("p")), labels.gml_safe(F.col("p"))).collect()]
    assert found == [("idAno-1_2", ".pri", "/d/idAno12prifagz"), ("x", ".alt", "xalt1fa/"), ("plain", "", "plain"), ("a", "", "apri"), ("", "", ""), (None, None, None)]


def test_components_with_an_excluded_class_go_whole(spark):
    nodes = spark.createDataFrame([("a", "LTR"), ("b", "LTR/Gypsy"), ("c", "LTR"), ("d", None), ("e", "LTR"), ("f", "non-LTR"), ("g", "LTR"), (None, "LTR")], "node string, class string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("g", "z"), ("e", "e"), (None, "a")], "x string, y string")
    found = {tuple(r) for r in graph.without_classes(nodes, edges, "x", "y").collect()}
    assert found == {("a", "LTR", "a"), ("b", "LTR/Gypsy", "a"), ("e", "LTR", "e")}
    assert graph.without_classes(nodes.where("false"), edges.where("false"), "x", "y").count() == 0


def test_indels_between_blocks_in_bins_of_any_width(spark):
    rows = [("p", "q", 0, 10, 0, 10), ("p", "q", 100, 110, 20, 30), ("p", "q", 120, 130, 200, 210), ("p", "q", 130, 140, 190, 200), ("p", "q", None, 1, 2, 3), ("p", "r", 0, 10, 0, 10), ("p", "q", 0, 10, 0, 10)]
    blocks = spark.createDataFrame(rows, "m string, n string, sa long, ea long, sb long, eb long").withColumn("pair", F.lit("x"))
    want = {("p", "q", "a", 10, 100, 80), ("p", "q", "b", 30, 200, 160)}
    for width in (7, 64, 1 << 16):
        assert {tuple(r) for r in co.large_indels(blocks, "m", "n", 50, width).collect()} == want
    assert co.large_indels(blocks.where("false"), "m", "n").count() == 0


def test_tandem_bed_and_overflow(spark):
    a = spark.createDataFrame([(0, 5, 20, 10, 30), (0, 7, 7, 7, 7), (1, None, 2, 3, 4), (9, 1, 2, 3, 4)], "seq_index int, s1 long, e1 long, s2 long, e2 long")
    s = spark.createDataFrame([(0, "chr1", 100), (1, None, 5)], "seq_index int, name string, scaf_len long")
    assert [tuple(r) for r in co.tandem_bed(a, s).collect()] == [("chr1", 5, 30)]
    c = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 2, 2, 3, 4, 90])], "word long, n long")
    assert {tuple(r) for r in seeds.bucket_histogram(c, 3).collect()} == {(2, 2), (3, 1), (None, 2)}
