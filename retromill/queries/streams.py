"""The query on arriving links."""

from __future__ import annotations

import os
import uuid

from retromill.queries.registry import query
from retromill.shared import shared_dir, table
from retromill.streaming.increments import grow_components, read_state


@query("""with recursive e as (select distinct name_a as a, name_b as b from match_pairs where name_a <> name_b), s as (select a, b from e union select b, a from e),
reach(name, other) as (select a, b from s union select reach.name, s.b from reach join s on reach.other = s.a) select name as node, min(other) as component from reach group by name""")
def incremental_components(spark, d):
    """Components of all names in ``match_pairs``, read file by file as a stream."""
    schema = table(spark, d, "match_pairs").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    path = f"{d}/match_pairs.parquet"
    links = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "match_pairs.parquet").parquet(d)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = grow_components(links.where("name_a <> name_b").select("name_a", "name_b"), "name_a", "name_b", f"{folder}/state", f"{folder}/progress")
    run.awaitTermination()
    return read_state(spark, f"{folder}/state", run.lastProgress["batchId"] if run.lastProgress else -1)
