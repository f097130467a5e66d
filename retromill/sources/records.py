"""The element table: one row for each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_records(rows: DataFrame, *columns: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """One row for each non-null ``name``: the one with the latest ``loaded_at`` (null before all
    others; among equals the greatest in the order of ``columns``). ``columns`` that are strings
    come in upper case with '' for null, those in ``plain`` as they are. Rows without a name are no records and are left out."""
    kinds = dict(rows.dtypes)
    read = {c: F.upper(F.coalesce(F.col(c), F.lit(""))) if kinds[c] == "string" else F.col(c) for c in columns}
    read |= {c: F.col(c) for c in plain}
    columns = (*columns, *plain)
    rows = rows.where(F.col("name").isNotNull()).select("name", "loaded_at", *(e.alias(c) for c, e in read.items()))
    if not columns:
        return rows.select("name").distinct()
    best = F.max(F.struct("loaded_at", *columns)).alias("best")
    return rows.groupBy("name").agg(best).select("name", *(F.col(f"best.{c}").alias(c) for c in columns))
