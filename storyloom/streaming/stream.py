"""Structured Streaming: event streams, deduplication, windows, and a sink that commits each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators.ingest import claimed, split


def event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream, some files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """The Parquet table folder/name, a file or a folder of files, as a stream."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(f"{folder}/{name}") if whole else reader.option("pathGlobFilter", name).parquet(folder)


def deduplicated(stream: DataFrame, key: str, when: str, keep: str = "21 days") -> DataFrame:
    """Each key once within the watermark: bounded state, weaker than a ledger that never forgets."""
    return stream.withWatermark(when, keep).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, when: str, kind: str, late: str = "2 hours") -> DataFrame:
    """Counts by tumbling hour and kind."""
    return stream.withWatermark(when, late).groupBy(F.window(when, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), kind, "n")


def sessions(stream: DataFrame, when: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A native extension: activity sessions of a key."""
    return stream.withWatermark(when, late).groupBy(F.session_window(when, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def look_back(stream_a: DataFrame, stream_b: DataFrame, key: str, when: str, hours: int = 72) -> DataFrame:
    """Pairs of equal key where b comes up to `hours` after a; watermarks let the state go beyond the window."""
    late = f"{hours} hours"
    a = stream_a.withWatermark(when, late).select(F.col(key).alias("key_a"), F.col(when).alias("time_a"), F.col("id").alias("id_a"))
    b = stream_b.withWatermark(when, late).select(F.col(key).alias("key_b"), F.col(when).alias("time_b"), F.col("id").alias("id_b"))
    return a.join(b, F.expr(f"key_a = key_b AND id_a <> id_b AND time_b BETWEEN time_a AND time_a + INTERVAL {hours} HOURS"))


def batch_sink(check: Callable[[DataFrame], DataFrame], key: str, order: list[str], good: str, rejected: str, ledger: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows with errors go to the rejects, of the others each key is claimed once for all time.

    Tables are written by batch number, so a batch that is run again after a failure replaces its own files, and the
    ledger that it reads leaves its own number out: the outcome is as if it ran once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        valid, rejects = split(check(batch))
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(ledger)
        known = None
        if hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
            known = spark.read.schema(f"{key} string, batch bigint").parquet(ledger).where(F.col("batch") != number)
        fresh = claimed(valid, key, order, known)
        fresh.write.mode("overwrite").parquet(f"{good}/batch={number}")
        spark.read.parquet(f"{good}/batch={number}").select(key).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        rejects.write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return run


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream until its source is empty; offsets are committed after each batch's sink returns."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counted_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """The stream's result as a table in memory, after the source is empty; for results that are small by nature."""
    spark = stream.sparkSession
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def written_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The whole result of an aggregating stream as a table under path, after its source is empty. Each batch replaces the
    one before, so that a batch that is run again leaves the same table; nothing is kept in the driver."""

    def replaced(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(replaced).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
