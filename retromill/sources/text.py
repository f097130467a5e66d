"""Readers and writers of the pipeline's text files. All are splittable: a large file is read by many
tasks, and the order of its records is kept as a column where it means something."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from retromill.operators.classes import class_label
from retromill.operators.coordinates import number_rows, running_sum
from retromill.shared import materialize


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with ``at``, their place in the files."""
    return lines.select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))


def read_fasta(spark: SparkSession, path: str, last_wins: bool = False) -> DataFrame:
    """``seq_index`` (from 0, in file order), ``name``, ``descr``, ``header``, ``seq``. Gzipped files are read too,
    each by one task. With ``last_wins`` a later record replaces earlier ones of its name."""
    records = _placed(spark.read.option("lineSep", "\n>").text(path)).withColumn("value", F.regexp_replace("value", r"^>|\r", "")).where("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    rest = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    r = records.select("at", F.trim(head).alias("header"), F.regexp_replace(rest, r"\s", "").alias("seq"))
    r = r.withColumn("name", F.regexp_extract("header", r"^(\S*)", 1)).withColumn("descr", F.regexp_extract("header", r"^\S*\s*(.*)$", 1))
    if last_wins:
        r = r.groupBy("name").agg(F.max(F.struct("at", "header", "descr", "seq")).alias("x")).select("name", "x.*")
    r = number_rows(r, "at", name="seq_index").withColumn("seq_index", F.col("seq_index") - 1)
    return r.select("seq_index", "name", "descr", "header", "seq")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``seq_index``, ``name``, ``descr``, ``seq``, ``qual`` of records of four lines."""
    lines = number_rows(_placed(spark.read.text(path)), "at", name="ord").select(F.expr("(ord - 1) div 4").alias("seq_index"), ((F.col("ord") - 1) % 4).alias("k"), "value")
    one = lines.groupBy("seq_index").agg(*(F.max(F.when(F.col("k") == k, F.col("value"))).alias(n) for k, n in ((0, "header"), (1, "seq"), (3, "qual"))))
    h = F.regexp_replace("header", "^@", "")
    return one.select("seq_index", F.regexp_extract(h, r"^(\S*)", 1).alias("name"), F.regexp_extract(h, r"^\S*\s*(.*)$", 1).alias("descr"), "seq", "qual")


def write_fasta(rows: DataFrame, header: str, seq: str, path: str, width: int = 0, order: list[str] | None = None) -> None:
    """One record for each row, '>' before the header unless it is there, wrapped to ``width`` columns if
    that is given, range-sorted by ``order`` over the written files if that is given."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else F.col(seq)
    text = F.concat(F.when(F.col(header).startswith(">"), F.col(header)).otherwise(F.concat(F.lit(">"), header)), F.lit("\n"), F.coalesce(body, F.lit("")))
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(text.alias("value")).write.text(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``name``: distinct lines without blanks around; empty lines and '#' comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("name"))
    return lines.where("name <> '' and not startswith(name, '#')").distinct()


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``seq_index``, ``start``, ``end``, ``element_id``, ``round`` (null if not there). Comments and lines of fewer
    than four columns are skipped; of repeated elements the last line counts."""
    lines = _placed(spark.read.text(path)).where("not startswith(value, '#')").withColumn("f", F.split("value", "\t")).where(F.size("f") >= 4)
    p = lines.select("at", F.col("f")[0].cast("int").alias("seq_index"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), F.col("f")[3].alias("element_id"), F.try_element_at("f", F.lit(5)).cast("int").alias("round"))
    return p.groupBy("element_id").agg(F.max(F.struct("at", "seq_index", "start", "end", "round")).alias("x")).select("x.seq_index", "x.start", "x.end", "element_id", "x.round")


def write_bed(rows: DataFrame, path: str, order: list[str]) -> None:
    """Tab-separated columns of ``rows`` as they are, range-sorted."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("sep", "\t").csv(path)


def write_membership(rows: DataFrame, path: str, most: int = 1000) -> None:
    """Lines of ``consensus`` and its members with commas between, about ``most`` members in a line: a consensus with more
    has several lines, so that no task holds all members of one."""
    n = rows.groupBy("consensus").agg(F.count(F.lit(1)).alias("_n"))
    parts = rows.join(n, "consensus").groupBy("consensus", F.expr(f"pmod(xxhash64(member), ceil(_n / {most}D))").alias("_part"))
    lines = parts.agg(F.array_join(F.sort_array(F.collect_list("member")), ",").alias("members"))
    lines.select(F.concat_ws("\t", "consensus", "members").alias("value")).write.text(path)


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """``consensus``, ``member``: one row for each member of a line; the heading and short lines are skipped."""
    lines = spark.read.text(path).where("not startswith(value, 'consensus\t')").withColumn("f", F.split(F.trim("value"), "\t")).where(F.size("f") >= 2)
    return lines.select(F.col("f")[0].alias("consensus"), F.explode(F.split(F.col("f")[1], ",")).alias("member"))


def read_calls(spark: SparkSession, path: str, db: str) -> DataFrame:
    """Classifier calls of one database: ``db``, ``te_id``, ``class_label``, ``domains``, ``strand``, ``complete``,
    ``clade``. Comments and lines of fewer than seven columns are skipped; of repeated ids the last counts."""
    lines = _placed(spark.read.text(path)).where("not startswith(value, '#')").withColumn("f", F.split(F.trim("value"), "\t")).where(F.size("f") >= 7)
    f = lambda i: F.col("f")[i]
    p = lines.select("at", f(0).alias("te_id"), class_label(f(1), f(2)).alias("class_label"), f(6).alias("domains"), f(5).alias("strand"), f(4).alias("complete"), f(3).alias("clade"))
    cols = ["class_label", "domains", "strand", "complete", "clade"]
    return p.groupBy("te_id").agg(F.max(F.struct("at", *cols)).alias("x")).select(F.lit(db).alias("db"), "te_id", *(F.col(f"x.{c}").alias(c) for c in cols))


def read_line_objects(spark: SparkSession, path: str) -> DataFrame:
    """``ord`` (from 0), ``kind`` (the first letter), ``fields``: the lines of a file of typed lines (ASCII) after its header."""
    lines = _placed(spark.read.text(path)).where(F.col("value").rlike("^[A-Za-z]"))
    return number_rows(lines, "at", name="ord").select((F.col("ord") - 1).alias("ord"), F.substring("value", 1, 1).alias("kind"), F.split(F.trim(F.expr("substring(value, 2)")), " +").alias("fields"))


def line_kinds(lines: DataFrame) -> DataFrame:
    """``kind``, ``n``, ``total``, ``longest``: lines of each kind, and of their first number the sum and maximum."""
    first = F.try_element_at("fields", F.lit(1)).try_cast("long")
    return lines.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("total"), F.max(first).alias("longest"))


def alignments_from_lines(lines: DataFrame) -> DataFrame:
    """``scaffold_idx``, ``r1s``, ``r1e``, ``r2s``, ``r2e``: alignments in scaffold coordinates. Contigs lie in
    their scaffold after the contigs and gaps before them; an alignment counts if it is closed and
    neither side is empty."""
    number = lambda i: F.try_element_at("fields", F.lit(i)).try_cast("long")
    one = lines.withColumn("all", F.lit(0)).withColumn("is_s", (F.col("kind") == "S").cast("long")).withColumn("is_c", (F.col("kind") == "C").cast("long")).withColumn("is_a", (F.col("kind") == "A").cast("long"))
    for c, name in (("is_s", "s"), ("is_c", "contig"), ("is_a", "a")):
        one = running_sum(one, "all", "ord", c, name, 10_000, 10_000)
    length = F.when(F.col("kind").isin("C", "G"), number(1)).otherwise(0)
    one = running_sum(one.withColumn("len", length), "s", "ord", "len", "offset", 10_000)
    one, _ = materialize(one.select("kind", "fields", "s", "contig", "a", "offset"))
    contigs = one.where("kind = 'C'").select("contig", (F.col("s") - 1).alias("scaffold_idx"), "offset")
    closed = one.where("kind = 'U'").select(F.col("a").alias("k")).distinct()
    al = one.where("kind = 'A'").select((F.col("a") + 1).alias("k"), number(1).alias("contig"), *(number(i).alias(c) for i, c in ((2, "a_s"), (3, "a_e"), (5, "b_s"), (6, "b_e"))))
    both = al.join(closed, "k", "left_semi").join(contigs, "contig").where("b_e <> b_s and a_e <> a_s")
    return both.select("scaffold_idx", *((F.col("offset") + F.col(c)).alias(n) for c, n in (("b_s", "r1s"), ("b_e", "r1e"), ("a_s", "r2s"), ("a_e", "r2e"))))


def rows_between(lines: DataFrame, ranges: list[tuple[int, int]], ord_: str = "ord") -> DataFrame:
    """Rows whose ordinal is in one of the half-open ``ranges``; ``request`` is the number of the range."""
    spark = lines.sparkSession
    wanted = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ranges)], "request int, lo long, hi long")
    return lines.join(F.broadcast(wanted), (F.col(ord_) >= F.col("lo")) & (F.col(ord_) < F.col("hi"))).drop("lo", "hi")


def has_columns(df: DataFrame, needed: StructType) -> bool:
    """Whether a table has all needed columns with their types; it may have more."""
    have = {f.name: f.dataType for f in df.schema}
    return all(have.get(f.name) == f.dataType for f in needed)


@F.pandas_udf(DoubleType())
def percent(ident: pd.Series) -> pd.Series:
    """Divergence in percent with one digit, rounded as Python does, on the exact value, which no built-in function does.
    A null or NaN gives null."""
    x = (1.0 - ident.to_numpy(np.float64, na_value=np.nan)) * 100.0
    return pd.Series(np.char.mod("%.1f", x).astype(np.float64)).where(~np.isnan(x))
