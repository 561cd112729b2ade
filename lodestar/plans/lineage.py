"""Intermediate tables, written to the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_temporary: dict[str, str] = {}
_paths = "_lodestar_path"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests), a new temporary
    folder; on a cluster a folder of one machine would lose rows without an error, so that is refused."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _temporary:
        _temporary[sc.applicationId] = tempfile.mkdtemp(prefix="lodestar-")
    return _temporary[sc.applicationId]


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df written once as Parquet in the shared folder, and read again.

    It cuts the lineage: loops don't recompute earlier rounds, and a lost executor costs a re-read. The table goes with
    ``discard`` after its last read, or when the driver ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{shared_folder(spark)}/lodestar/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _paths, path)
    return out


_kept: dict[tuple[str, str], tuple[str, StructType]] = {}


def once(spark: SparkSession, label: str, build) -> DataFrame:
    """The table of that label, built and written at the first call in an application and only read later: facts that many
    questions share. The label must name what the table is made of."""
    key = (spark.sparkContext.applicationId, label)
    if key not in _kept:
        df = written(build(), "facts")
        _kept[key] = getattr(df, _paths), df.schema
    path, schema = _kept[key]
    return spark.read.schema(schema).parquet(path)  # a new frame each time, so that it can be joined with itself


def discard(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more. Others (and None) are left alone."""
    for df in tables:
        path = getattr(df, _paths, None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
            setattr(df, _paths, None)
