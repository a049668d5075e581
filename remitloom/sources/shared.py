"""The folder that all executors share, for checkpoints and written intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_FALLBACK: list[str] = []
_USED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset (local tests) a temporary folder of this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="remitloom-"))
        atexit.register(shutil.rmtree, _FALLBACK[0], ignore_errors=True)
    return f"file://{_FALLBACK[0]}"


def literal(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A few rows of configuration as a local relation, whose size the optimizer knows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = spark.createDataFrame([], schema).schema
    table = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, table)], schema=table), schema=fields)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _USED.add(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives the loss of executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class temporary:  # noqa: N801
    """``df`` written like :func:`written`, for a result that can be deleted as soon as what is made of it is written."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, fresh_path(df.sparkSession, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def forget(self, keep: bool = False) -> None:
        """Deletes the files, unless something that isn't written yet still reads them."""
        if not keep:
            delete(self.spark, self.path)
            _USED.discard(self.path)


def clean(spark: SparkSession) -> int:
    """Deletes everything this program has written to the shared folder; to be called once no result is read any more."""
    count = 0
    while _USED:
        delete(spark, _USED.pop())
        count += 1
    return count


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
