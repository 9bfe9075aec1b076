"""Working folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from itertools import batched

from pyspark.sql import DataFrame, SparkSession

_where_unset: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where none is named, a temporary one for a local session (tests), else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _where_unset:
            _where_unset[app] = "file://" + tempfile.mkdtemp(prefix="quarryfield-")
        where = _where_unset[app]
    return where.rstrip("/")


def file_of(spark: SparkSession, uri: str):
    """(path, file system) of Hadoop's layer."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def work_dir(spark: SparkSession, operator: str) -> str:
    """A fresh folder below the shared one; it goes when the application ends, as results are read from it until then."""
    where = f"{shared_dir(spark)}/quarryfield/{operator}-{uuid.uuid4().hex}"
    path, files = file_of(spark, where)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return where


def materialise(df: DataFrame, where: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table and read it back: the plan after it starts from files."""
    df.write.option("compression", codec).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def gathered(spark: SparkSession, rows: Iterable[tuple], schema: str, where: str, block: int = 1 << 17) -> DataFrame:
    """Rows that reach the driver one after the other, as a Parquet table in the existing folder ``where``; the driver holds one block of them."""
    for part in batched(rows, block):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(where)
    return spark.read.schema(schema).parquet(where)


def remove(spark: SparkSession, uri: str) -> None:
    path, files = file_of(spark, uri)
    files.delete(path, True)
