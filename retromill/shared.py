"""Tables that cut the lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where the session
    names none and runs in a single process, as in tests."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-retromill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: folders that this process has written for each application and not yet deleted
_WRITTEN: dict[str, set[str]] = {}


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder for a table or file of an operator, deleted by :func:`release`."""
    path = f"{shared_dir(spark)}/retromill-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all tables that operators have written for this application, and say how many. Results that have not been
    written yet read them, so call it when the results are."""
    written = _WRITTEN.pop(spark.sparkContext.applicationId, set())
    for path in written:
        discard(spark, path)
    return len(written)


def materialize(df: DataFrame, *metrics) -> tuple[DataFrame, dict]:
    """Write ``df`` as Parquet into the shared folder and read it back, so that a lost executor
    costs no recomputation of what came before. ``metrics`` are aggregate columns that are
    gathered while the rows are written."""
    spark = df.sparkSession
    path = scratch(spark)
    observed = None
    if metrics:
        from pyspark.sql import Observation

        observed = Observation()
        df = df.observe(observed, *metrics)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    return back, (observed.get if observed else {}) | {"path": path}


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`materialize` wrote and nothing reads any more."""
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: keys with up to so many rows are never hot
FEW = 100_000


def join_hot_keys(rows: DataFrame, side: DataFrame, key: str, n: str, total: int, most: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has each ``key`` once and in ``n`` the number of
    rows with it. Keys with more than a ``most``-th of all ``total`` rows are at most ``most``; they
    are broadcast, so that their rows stay where they are. All others are joined by a shuffle, in
    which no key holds more than that share."""
    limit = max(FEW, total // most)
    hot, cold = side.where(F.col(n) > limit), side.where(F.col(n) <= limit)
    if total <= limit:
        return rows.join(cold, key)
    cols = [c for c in side.columns if c != key]
    hot = hot.select(key, *(F.col(c).alias(f"hot_{c}") for c in cols))
    tagged = rows.join(F.broadcast(hot), key, "left")
    known = tagged.where(F.col(f"hot_{n}").isNotNull()).select(*rows.columns, *(F.col(f"hot_{c}").alias(c) for c in cols))
    other = tagged.where(F.col(f"hot_{n}").isNull()).select(*rows.columns).join(cold, key)
    return known.unionByName(other.select(*rows.columns, *cols))


def keep_partitions(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder. Unlike a table read back, it has the partitions and the
    order of rows exactly as written."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into as many partitions as shuffles have, not fewer because the rows are
    few: for rows that are small but costly. A join or grouping by the same keys shuffles no more."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
