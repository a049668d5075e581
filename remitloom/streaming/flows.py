"""Streams of transactions and envelopes: the same operators over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitloom.plans import questions as Q
from remitloom.sources.shared import fresh_path
from remitloom.sources.tables import table


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """One parquet table, a file or a folder, as a stream; at most ``files_per_batch`` files a micro-batch."""
    reader = spark.readStream.schema(table(spark, folder, name).schema).option("maxFilesPerTrigger", files_per_batch)
    path = f"{folder}/{name}.parquet"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def exactly_once(stream: DataFrame, event_time: str, lateness: str, *identity: str) -> DataFrame:
    """One delivery of each message within the watermark. Rows with a NULL part of the identity bypass it and stay.

    Copies further apart than ``lateness`` need :class:`remitloom.operators.dedup.SeenStore` in ``foreachBatch``.
    """
    marked = stream.withWatermark(event_time, lateness)
    stated = None
    for c in identity:
        stated = F.col(c).isNotNull() if stated is None else stated & F.col(c).isNotNull()
    return marked.filter(stated).dropDuplicatesWithinWatermark(list(identity)).unionByName(marked.filter(~stated))


def small_transfers(stream: DataFrame) -> DataFrame:
    return Q.q1(stream)


def format_averages(stream: DataFrame) -> DataFrame:
    return Q.format_averages(stream)


def run_available(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Runs a stream over all input there is, and returns what it wrote.

    Append results go to parquet; the file sink's log makes them exactly-once. A complete result replaces the files
    of the one before. Checkpoint and output are in the shared folder unless given.
    """
    spark = stream.sparkSession
    out, checkpoint = out or fresh_path(spark, "stream-out"), checkpoint or fresh_path(spark, "stream-log")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").option("path", out).start()
    else:
        running = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ingest_batches(stream: DataFrame, store, checkpoint: str, out: str):
    """Feeds (row_id, ident, at) micro-batches to a seen store and appends the kept row ids under ``out``.

    Each batch goes to ``out/batch=<id>`` and is named to the store by its id: a batch that is run again after a
    failure gets the answer it got the first time and overwrites its folder, so every message comes out exactly once.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        store.ingest(batch, f"batch-{batch_id}").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
