"""Written intermediate tables: the way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


#: Where tables that ``cut`` wrote are.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset (tests on one machine) a fresh local
    folder is made and set for the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("skillcorpus.shared.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("skillcorpus.shared.dir", folder)
    return folder


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    The written table survives lost executors (nothing is recomputed from lineage behind it) and is what a
    step that is read more than once should go through.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    _PATHS[written] = path
    return written


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote and that nothing reads any more, so that they take no room while a job goes on."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deals rows out by ``key`` where the input has too few splits for the cores at hand, as small files have.

    Jobs that scan texts are bound by CPU; a large input comes in many splits and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
