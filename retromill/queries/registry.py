"""Where queries and the SQL that gives the same rows are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: one row for each record, as ``distinct_records`` reads it
RECORDS = """r as (select * from (select name, upper(coalesce(full_seq, '')) as full_seq, upper(coalesce(ltr5, '')) as ltr5,
upper(coalesce(internal, '')) as internal, upper(coalesce(ltr3, '')) as ltr3, upper(coalesce(flank_l, '')) as flank_l,
upper(coalesce(flank_r, '')) as flank_r, genome, round, row_number() over (partition by name order by loaded_at desc) as copy
from ltr_records where name is not null) where copy = 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{records}", RECORDS)
        return f

    return add
