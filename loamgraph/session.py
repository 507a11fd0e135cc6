"""Session helpers: the shared working folder and the size of a driver-side table."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only a local session may leave it unset (as in tests); it then gets a folder of its own.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if own:
        if not held.isDefined():  # named after the context had started
            sc.setCheckpointDir(own)
        return own.rstrip("/")
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = os.path.join(tempfile.gettempdir(), f"loamgraph-{os.getpid()}")
    os.makedirs(base, exist_ok=True)
    sc.setCheckpointDir(base)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(spark: SparkSession, name: str, of: str) -> str:
    """The path of what is kept between runs over the tables in ``of``: in ``spark.loamgraph.state.dir`` if that is set,
    else in the shared folder."""
    base = spark.conf.get("spark.loamgraph.state.dir", None) or shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-v2-{hashlib.sha256(of.rstrip('/').encode()).hexdigest()[:24]}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: used where a result is read several times."""
    path = scratch(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Intermediate results of this process; queries are lazy, so they stay until their owner calls ``clean``.
_written: list[str] = []


def clean(spark: SparkSession) -> int:
    """Delete the intermediate results written so far, once nothing built on them is to run any more; how many."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = 0
    while _written:
        p = path(_written.pop())
        gone += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return gone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
