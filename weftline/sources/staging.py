"""The folder all executors share, and stages written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine gets a temporary folder; a cluster must name one, as its machines share no disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def _drop_written() -> None:
    for jvm_path, conf in _written:
        try:
            jvm_path.getFileSystem(conf).delete(jvm_path, True)
        except Exception:  # noqa: BLE001 - the session may have ended already
            pass
    _written.clear()


atexit.register(_drop_written)


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: a cut in the lineage that outlives any executor.

    ``by``: its last columns, of whose values each has a folder of its own.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    _written.append((spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()))
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(schema: T.StructType) -> Column:
    """About what a row takes in memory: a word for each column, and what strings and arrays hold."""
    out = F.lit(8 + 8 * len(schema))
    for f in schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            out += 8 * F.coalesce(F.size(c), F.lit(0)) if not isinstance(f.dataType.elementType, T.StringType) else F.coalesce(F.octet_length(F.array_join(c, "        ")), F.lit(0))
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            out += F.octet_length(F.to_json(c))
    return out
