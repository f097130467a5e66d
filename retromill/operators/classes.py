"""Classes of library entries: header parsing, merging of calls, the final library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retromill.operators.coordinates import number_rows

#: one name for a superfamily that two databases name differently (fixed values)
ALIASES = {"Pao": "Bel-Pao", "Retroviridae": "Retrovirus"}
#: the call of an entry that no database knows (fixed values)
UNCLASSIFIED = {"class_label": "Unknown", "domains": "none", "strand": "?", "complete": "no", "clade": "unknown"}


def is_ltr(label: Column) -> Column:
    """LTR alone or with a superfamily, in any case, a trailing '?' aside; null is not."""
    return F.coalesce(F.regexp_replace(F.trim(label), r"\?+$", "").rlike(r"(?i)^LTR(/|$)"), F.lit(False))


def class_label(order: Column, superfamily: Column) -> Column:
    """LTR with its superfamily where known, other orders as unknown, no order as Unknown."""
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    sf = F.coalesce(table[superfamily], superfamily)
    return F.when((order == "LTR") & (sf != "unknown"), F.concat(F.lit("LTR/"), sf)).when(order != "Unknown", F.concat(order, F.lit("/unknown"))).otherwise("Unknown")


def tag(header: Column, name: str) -> Column:
    """The value of a ``name=value`` token of a description line, '' if it has none."""
    return F.regexp_extract(header, rf"(?:^|\s){name}=(\S+)", 1)


def span(header: Column, name: str, end: bool) -> Column:
    """The start or end of a ``name=a-b`` token, null if it has none."""
    found = F.regexp_extract(header, rf"{name}=(\d+)-(\d+)", 2 if end else 1)
    return F.when(found != "", found.cast("long"))


def first_word(header: Column) -> Column:
    return F.regexp_extract(header, r"^>?\s*(\S+)", 1)


def classified_class(header: Column) -> Column:
    """The class of a classified entry: ``class=``, else the first later word that begins with '#',
    whichever is first, else unknown."""
    rest = F.regexp_extract(header, r"^>?\s*\S+(.*)$", 1)
    found = F.regexp_extract(rest, r"\s(?:class=|#+)(\S*)", 1)
    return F.when(rest.rlike(r"\s(class=|#)"), found).otherwise("unknown")


def library_class(header: Column) -> Column:
    """The class of a library entry: ``class=``, else what follows '#' in its name, else Unknown."""
    name = first_word(header)
    return F.when(tag(header, "class") != "", tag(header, "class")).when(name.contains("#"), F.regexp_extract(name, "#(.*)$", 1)).otherwise("Unknown")


def library_name(header: Column) -> Column:
    """The name: up to '#' unless the class has its own token."""
    name = first_word(header)
    return F.when(tag(header, "class") != "", name).otherwise(F.regexp_extract(name, "^([^#]*)", 1))


def element_coordinates(headers: DataFrame) -> DataFrame:
    """``name``, ``scaffold``, ``r1_start``, ``r2_end`` of description lines that have both repeats."""
    h = F.col("header")
    parsed = headers.select(first_word(h).alias("name"), tag(h, "scaffold").alias("scaffold"), span(h, "repeat1", False).alias("r1_start"), span(h, "repeat2", True).alias("r2_end"))
    return parsed.where("r1_start is not null and r2_end is not null")


def load_elements(fasta: DataFrame) -> DataFrame:
    """Elements from description lines and sequences (``header``, ``seq``): features are cut by scaffold
    coordinates less the start of the extract, each held between the one before and the end. Entries
    without left flank or repeats are left out."""
    h = F.col("header")
    p = fasta.select(first_word(h).alias("name"), F.upper("seq").alias("full_seq"), tag(h, "genome").alias("genome"), span(h, "flank_l", False).alias("fl"), *(span(h, n, e).alias(f"{n}{int(e)}") for n in ("repeat1", "repeat2") for e in (False, True)))
    p = p.where("fl is not null and repeat10 is not null and repeat20 is not null")
    n = F.length("full_seq").cast("long")
    inside = lambda c, low: F.greatest(low, F.least(F.col(c) - F.col("fl"), n))
    p = p.withColumn("r1s", inside("repeat10", F.lit(0).cast("long")))
    for name, c, low in (("r1e", "repeat11", "r1s"), ("r2s", "repeat20", "r1e"), ("r2e", "repeat21", "r2s")):
        p = p.withColumn(name, inside(c, F.col(low)))
    cut = lambda a, b: F.substring("full_seq", (a + 1).cast("int"), (b - a).cast("int"))
    c = F.col
    zero = F.lit(0).cast("long")
    return p.select("name", "full_seq", cut(c("r1s"), c("r1e")).alias("ltr5"), cut(c("r1e"), c("r2s")).alias("internal"), cut(c("r2s"), c("r2e")).alias("ltr3"), cut(zero, c("r1s")).alias("flank_l"), cut(c("r2e"), n).alias("flank_r"), "genome")


def merge_calls(ids: DataFrame, calls: DataFrame, order: list[str]) -> DataFrame:
    """One call for each ``te_id`` of ``ids`` from ``calls`` (``db``, ``te_id``, ``class_label``, ``domains``,
    ``strand``, ``complete``, ``clade``): the first database in ``order`` that says LTR, else the first
    with any call, else the unclassified call with a null ``db``. Repeated calls of a database count
    by the greatest label. Partial minima, so an entry with very many calls is no hot task."""
    rank = F.coalesce(*(F.when(F.col("db") == db, F.lit(i)) for i, db in enumerate(order)))
    cols = ["db", *UNCLASSIFIED]
    best = calls.where(rank.isNotNull()).groupBy("te_id", rank.alias("rank")).agg(F.max(F.struct("class_label", *(c for c in cols if c != "class_label"))).alias("x"))
    best = best.groupBy("te_id").agg(F.min(F.struct((~is_ltr(F.col("x.class_label"))).alias("other"), "rank", "x")).alias("y")).select("te_id", *(F.col(f"y.x.{c}").alias(c) for c in cols))
    joined = ids.select("te_id").distinct().join(best, "te_id", "left")
    return joined.select("te_id", "db", *(F.when(F.col("class_label").isNull(), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in UNCLASSIFIED.items()))


def classified_header(entries: DataFrame) -> DataFrame:
    """``header``: description lines with class, domains, strand, clade, complete and database."""
    db = F.when(F.col("db").isNotNull(), F.concat(F.lit(" db="), "db")).otherwise("")
    return entries.select("te_id", F.concat(F.lit(">"), "te_id", F.lit(" class="), "class_label", F.lit(" domains="), "domains", F.lit(" strand="), "strand", F.lit(" clade="), "clade", F.lit(" complete="), "complete", db).alias("header"))


def final_library(entries: DataFrame) -> DataFrame:
    """``ord``, ``header``, ``rm_header`` of the LTR entries of ``entries`` (``ord``, ``header``): repeated
    names are numbered from the second on in the order of ``ord``."""
    h = F.col("header")
    e = entries.select("ord", "header", library_name(h).alias("name"), library_class(h).alias("cls")).where(is_ltr(F.col("cls")))
    k = F.row_number().over(Window.partitionBy("name").orderBy("ord"))
    named = e.withColumn("k", k)
    rm = F.concat(F.lit(">"), "name", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(""), F.lit("#"), "cls")
    return named.select("ord", "header", rm.alias("rm_header"))


def class_of_elements(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``member``, ``consensus``, ``class``: the class of the consensus of each member, 'unassigned' if it
    has none. ``classes`` has ``consensus`` and ``class`` once for each consensus."""
    return members.join(classes, "consensus", "left").select("member", "consensus", F.coalesce("class", F.lit("unassigned")).alias("class"))


def numbered(entries: DataFrame, *keys: str) -> DataFrame:
    return number_rows(entries, *keys, name="ord")
