"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session.  A local session without
one gets a temporary folder; a cluster session without one is an error, since a
machine-local folder would be invisible to other executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="meshspan-")
        base = _local[app]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/meshspan/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once and read again: its lineage ends here, and lost executors cost nothing above it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``stored``, laid out by ``key`` so that joins on it need not shuffle this side."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = f"meshspan_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    return spark.table(table)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def distinct_names(wanted: list[str], taken: list[str]) -> list[str]:
    """``wanted`` names that clash with ``taken`` (any case) get underscores until they do not."""
    have = {t.lower() for t in taken}
    out = []
    for w in wanted:
        while w.lower() in have:
            w += "_"
        have.add(w.lower())
        out.append(w)
    return out
