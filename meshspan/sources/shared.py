"""A folder that driver and executors share, for what must be written on the way."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="meshspan-"))
    path = f"{base.rstrip('/')}/meshspan/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


_kept: dict[tuple[str, str], str] = {}


def kept(spark: SparkSession, name: str, build):
    """A table that is built once a session under ``name`` and read from the shared folder after that."""
    key = spark.sparkContext.applicationId, name
    if key not in _kept:
        path = shared_path(spark, "kept")
        build().write.parquet(path)
        _kept[key] = path
    return spark.read.parquet(_kept[key])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again; lost executors cost nothing above it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_digest(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order: the count and the sums of two hashes of every row."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))
    got = df.agg(F.count(F.lit(1)).alias("n"), wide(F.xxhash64(row)).alias("a"), wide(F.xxhash64(F.lit("second"), row)).alias("b")).first()
    return hashlib.sha256(repr((df.schema.json(), got.n, str(got.a), str(got.b))).encode()).hexdigest()


class Store:
    """Tables by the digest of what they were built from, in a folder that outlives the session.

    A table is written beside its place and moved there in one step, so readers
    see all of it or nothing; of two sessions that build the same table one move
    wins, and the other takes its table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def key(self, inputs: list[DataFrame], **params) -> str:
        return hashlib.sha256(json.dumps([[content_digest(d) for d in inputs], params], sort_keys=True, default=str).encode()).hexdigest()[:32]

    def path(self, name: str, key: str) -> str:
        return f"{self.root}/{name}/{key}"

    def has(self, name: str, key: str) -> bool:
        fs, p = self._fs(self.path(name, key))
        return fs.exists(p)

    def get(self, name: str, inputs: list[DataFrame], build, **params) -> DataFrame:
        """The table that ``build()`` gives for these inputs and parameters; built only if it isn't there."""
        key = self.key(inputs, **params)
        path = self.path(name, key)
        if not self.has(name, key):
            new = f"{self.root}/{name}/.new-{uuid.uuid4().hex}"
            build().write.parquet(new)
            fs, p = self._fs(new)
            _, q = self._fs(path)
            if fs.exists(q) or not fs.rename(p, q):
                if not fs.exists(q):
                    raise OSError(f"can't publish {path}")
                fs.delete(p, True)
        return self.spark.read.parquet(path)

    def keys(self, name: str) -> list[str]:
        """Published keys, the latest first; equal times by key."""
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = [(-s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p)]
        return [k for _, k in sorted(found) if not k.startswith(".")]

    def prune(self, name: str, keep: int) -> list[str]:
        """Removes all but the ``keep`` latest tables of a name; returns the keys that went."""
        gone = self.keys(name)[keep:]
        for k in gone:
            fs, p = self._fs(self.path(name, k))
            fs.delete(p, True)
        return gone


def store(spark: SparkSession) -> Store:
    """The store in the shared folder of the session; without one, a temporary folder's."""
    base = shared_path(spark, "store")
    return Store(spark, base[: base.rindex("/")] + "/store")
