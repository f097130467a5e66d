import gzip

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from retromill.operators import classes, coordinates, graph
from retromill.sources import params, text
from retromill.streaming.increments import grow_components, read_state


def test_fasta_round_trip(spark, tmp_path):
    rows = [(i, f"s{i}", f"s{i} scaffold=x len={i}", "ACGTN" * i) for i in range(1, 40)] + [(99, "s3", "s3 again", "TTT"), (100, "e", "e", "")]
    df = spark.createDataFrame(rows, "ord int, name string, header string, seq string").repartition(3)
    text.write_fasta(df, "header", "seq", str(tmp_path / "a"), width=7, order=["ord"])
    back = text.read_fasta(spark, str(tmp_path / "a")).orderBy("seq_index").collect()
    assert [(r.name, r.header, r.seq) for r in back] == [r[1:] for r in rows] and [r.seq_index for r in back] == list(range(len(rows)))
    last = {r.name: r.seq for r in text.read_fasta(spark, str(tmp_path / "a"), last_wins=True).collect()}
    assert last["s3"] == "TTT" and len(last) == len(rows) - 1


def test_gzip_and_carriage_returns(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(">one first record\r\nAC\r\nGT\r\n>two\r\n\r\nTT\r\n")
    assert [tuple(r) for r in text.read_fasta(spark, str(tmp_path / "a.fa.gz")).orderBy("seq_index").collect()] == [(0, "one", "first record", "one first record", "ACGT"), (1, "two", "", "two", "TT")]


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+\n@@\n")
    assert [tuple(r) for r in text.read_fastq(spark, str(tmp_path / "a.fq")).orderBy("seq_index").collect()] == [(0, "r1", "x", "ACGT", "IIII"), (1, "r2", "", "GG", "@@")]


def test_tables(spark, tmp_path):
    (tmp_path / "n").write_text("# list\n a \n\nb\na\n")
    assert sorted(r.name for r in text.read_names(spark, str(tmp_path / "n")).collect()) == ["a", "b"]
    (tmp_path / "b").write_text("#x\n0\t1\t2\te1\n1\t3\t4\n2\t5\t6\te2\t3\n0\t7\t8\te1\n")
    assert sorted(tuple(r) for r in text.read_bed(spark, str(tmp_path / "b")).collect()) == [(0, 7, 8, "e1", None), (2, 5, 6, "e2", 3)]
    (tmp_path / "m").write_text("consensus\tmembers\nC1\ta,b\nC2\nC3\tc\n")
    assert sorted(tuple(r) for r in text.read_membership(spark, str(tmp_path / "m")).collect()) == [("C1", "a"), ("C1", "b"), ("C3", "c")]
    lines = ["#TE\tOrder\tSuperfamily\tClade\tComplete\tStrand\tDomains", "a\tLTR\tPao\tx\tyes\t+\tGAG|x", "b\tLTR\tunknown\tx\tno\t-\tRT", "c\tUnknown\tunknown\tx\tno\t?\tnone", "d\tLTR", "e\tTIR\tMuDR\tx\tno\t-\tTPase", "a\tLTR\tGypsy\ty\tno\t-\tRT"]
    (tmp_path / "c").write_text("\n".join(lines))
    got = {r.te_id: (r.class_label, r.domains, r.strand, r.complete, r.clade, r.db) for r in text.read_calls(spark, str(tmp_path / "c"), "rexdb").collect()}
    assert got == {"a": ("LTR/Gypsy", "RT", "-", "no", "y", "rexdb"), "b": ("LTR/unknown", "RT", "-", "no", "x", "rexdb"), "c": ("Unknown", "none", "?", "no", "x", "rexdb"), "e": ("TIR/unknown", "TPase", "-", "no", "x", "rexdb")}


def test_alignments_from_lines(spark, tmp_path):
    (tmp_path / "o").write_text("\n".join(["1 3 aln 1 0", "# A 5", "S 4 scf1", "C 100", "G 20", "C 50", "S 4 scf2", "C 70", "A 0 50 60 0 10 20", "D 3", "U", "A 1 5 15 1 0 0", "U", "A 1 30 40 1 10 20", "A 2 9 19 2 1 11", "D 0", "U"]))
    lines = text.read_line_objects(spark, str(tmp_path / "o"))
    assert sorted(tuple(r) for r in text.alignments_from_lines(lines).collect()) == [(0, 10, 20, 50, 60), (1, 1, 11, 9, 19)]
    assert {r.kind: r.n for r in text.line_kinds(lines).collect()} == {"S": 2, "C": 3, "G": 1, "A": 4, "U": 3, "D": 2}
    some = text.rows_between(lines, [(6, 8), (0, 1)]).orderBy("request", "ord").collect()
    assert [(r.request, r.ord, r.kind) for r in some] == [(0, 6, "A"), (0, 7, "D"), (1, 0, "S")]


def test_schema_check():
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([], "a long, b string, c int")
    need = StructType([StructField("a", LongType()), StructField("b", StringType())])
    assert text.has_columns(df, need) and not text.has_columns(df.drop("b"), need) and not text.has_columns(df.withColumn("a", F.lit(1)), need)


def test_percent_rounds_as_python_does(spark):
    values = [0.9985, 0.85, 0.8, 1.0, 0.12345, 0.9995, 0.0]
    got = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").select(text.percent(F.col("x")).alias("p")).collect()
    assert [r.p for r in got] == [round((1 - v) * 100, 1) for v in values] + [None]


def test_loading_elements(spark):
    header = lambda n, a, b, c, extra="": f"{n} scaffold=s flank_l={a} repeat1={b} repeat2={c} flank_r=0-0{extra}"
    rows = [(header("x", "10-14", "14-18", "22-26", " genome=g1"), "aaaaCCCCGGGGCCCCtt"), (header("y", "0-2", "2-90", "5-7"), "ACGT"), ("z scaffold=s repeat1=1-2 repeat2=3-4", "ACGT"), (header("e", "0-1", "1-2", "2-3"), "")]
    got = {r.name: tuple(r)[1:] for r in classes.load_elements(spark.createDataFrame(rows, "header string, seq string")).collect()}
    assert got["x"] == ("AAAACCCCGGGGCCCCTT", "CCCC", "GGGG", "CCCC", "AAAA", "TT", "g1")
    assert got["y"] == ("ACGT", "GT", "", "", "AC", "", "") and got["e"] == ("", "", "", "", "", "", "") and "z" not in got


def test_class_predicates(spark):
    labels = ["LTR", "ltr/Gypsy", "LTR/Copia?", "LTRx", None, "", " LTR ", "DNA/LTR", "LTR??"]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select(classes.is_ltr(F.col("x")).alias("v")).collect()
    assert [r.v for r in got] == [True, True, True, False, False, False, True, False, True]
    headers = [">a#LTR/Copia x", ">b class=LTR", ">c #DNA", ">d", ">e##x class=TIR"]
    h = spark.createDataFrame([(x,) for x in headers], "h string").select(classes.classified_class(F.col("h")), classes.library_class(F.col("h")), classes.library_name(F.col("h"))).collect()
    assert [tuple(r) for r in h] == [("unknown", "LTR/Copia", "a"), ("LTR", "LTR", "b"), ("DNA", "Unknown", "c"), ("unknown", "Unknown", "d"), ("TIR", "TIR", "e##x")]


def test_calls_of_the_second_database_and_none(spark):
    calls = [("p", "a", "DNA/unknown"), ("q", "a", "LTR/Copia"), ("p", "b", "LTR"), ("q", "b", "LTR/Gypsy"), ("p", "c", "TIR/unknown"), ("q", "c", "DNA/unknown"), ("z", "d", "LTR"), ("p", "b", "LTR")]
    df = spark.createDataFrame([(*c, "dom", "+", "no", "cl") for c in calls], "db string, te_id string, class_label string, domains string, strand string, complete string, clade string")
    ids = spark.createDataFrame([(x,) for x in "abcdd"], "te_id string")
    got = {r.te_id: (r.db, r.class_label, r.domains) for r in classes.merge_calls(ids, df, ["p", "q"]).collect()}
    assert got == {"a": ("q", "LTR/Copia", "dom"), "b": ("p", "LTR", "dom"), "c": ("p", "TIR/unknown", "dom"), "d": (None, "Unknown", "none")}
    head = {r.te_id: r.header for r in classes.classified_header(classes.merge_calls(ids, df, ["p", "q"])).collect()}
    assert head["a"] == ">a class=LTR/Copia domains=dom strand=+ clade=cl complete=no db=q" and head["d"] == ">d class=Unknown domains=none strand=? clade=unknown complete=no"


def test_gml(spark):
    n = spark.createDataFrame([(0, "a-1_x"), (1, "b.2")], "id long, label string")
    e = spark.createDataFrame([(0, 1, 1.5, 2.0)], "source long, target long, ltr_div_pct double, int_div_pct double")
    lines = [r.line for r in graph.gml(n, e).orderBy("ord").collect()]
    assert lines[0] == "graph [" and 'label "a1x"' in lines[1] and "source 0\n    target 1\n    ltrdivergencepct 1.5" in lines[3] and lines[-1] == "]"


def test_run_parameters():
    run = {"run": {"command": "detect: all #1", "ok": True, "n": 3, "x": 0.25, "none": None, "text": '"quoted"\nline', "number": "12", "list": ["a b", "", 5, "true"]}, "input": {"genome": "g.fa"}}
    assert params.load(params.dump(run)) == run and params.may_resume(run, "g.fa") and not params.may_resume(run, "h.fa") and params.may_resume({}, "h.fa")


def test_components_grow_batch_by_batch(spark, tmp_path):
    pairs = [[("a", "b"), ("c", "d")], [("d", "b"), ("x", "x"), (None, "q")], [("m", "n"), ("n", "a"), ("a", "n")]]
    for i, p in enumerate(pairs):
        spark.createDataFrame(p, "a string, b string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a string, b string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = grow_components(stream, "a", "b", str(tmp_path / "state"), str(tmp_path / "progress"))
    q.awaitTermination()
    got = {r.node: r.component for r in read_state(spark, str(tmp_path / "state"), q.lastProgress["batchId"]).collect()}
    assert got == dict.fromkeys("abcdmn", "a") and q.lastProgress["batchId"] >= 2


def test_round_loop_takes_out_and_scans_again(spark):
    from retromill.plans.rounds import affected, original_positions, run_rounds

    rounds = {1: [("e1", 0, 10, 30), ("e2", 0, 50, 70), ("e3", 0, 90, 95), ("e4", 1, 0, 5)], 2: [("f1", 0, 20, 40), ("f2", 1, 0, 5)], 3: []}

    def detect(layers, k):
        return spark.createDataFrame(rounds[k], "name string, entity long, start long, end long")

    def link(nodes):
        n = nodes.where("entity = 0").select("name").orderBy("name")
        return n.alias("a").join(n.alias("b"), F.col("a.name") < F.col("b.name")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"))

    found, layers = run_rounds(detect, link, lambda f: f, 3)
    assert {r.member for r in found.collect()} == {"r1_e1", "r1_e2", "r1_e3", "r2_f1"}
    assert [sorted((r.entity, r.orig_start, r.orig_end) for r in x.collect()) for x in layers] == [[(0, 10, 30), (0, 50, 70), (0, 90, 95)], [(0, 20, 40)]]
    later = detect(layers, 2)
    at = {r.name: (r.start, r.end) for r in original_positions(later, layers[:1]).collect()}
    assert at["f2"] == (0, 5) and at["f1"] == (40, 80)
    assert [r.name for r in affected(spark.createDataFrame([("p", 0, 29, 40), ("q", 0, 30, 50)], "name string, entity long, start long, end long"), layers[0]).collect()] == ["p"]


def test_names_are_numbered_in_order(spark):
    df = spark.createDataFrame([(f"n{i:02}",) for i in range(30)][::-1], "name string")
    assert [r.ordinal for r in coordinates.number_rows(df, "name").orderBy("name").collect()] == list(range(1, 31))
