"""Sinks: append-only logs, content-addressed texts, events and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(events: DataFrame, path: str, when: str = "time") -> None:
    """The raw event log, partitioned by date."""
    events.withColumn("date", F.to_date(when)).write.mode("append").partitionBy("date").parquet(path)


def store_texts(texts: DataFrame, path: str) -> None:
    """Texts keyed by (doc_id, content_hash), written once: what the store has is passed over."""
    spark = texts.sparkSession
    fresh = texts.select("doc_id", "content_hash", "text").dropDuplicates(["doc_id", "content_hash"])
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop):
        fresh = fresh.join(spark.read.parquet(path).select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
    fresh.write.mode("append").parquet(path)


def text_key(date: str = "discovered_at", doc: str = "doc_id", digest: str = "content_hash"):  # noqa: ANN201
    return F.concat_ws("/", F.date_format(date, "yyyy-MM-dd"), F.concat(F.col(doc).cast("string"), F.lit("-"), F.left(digest, F.lit(16))))


def events_as_json(events: DataFrame) -> DataFrame:
    """key, value (JSON) and type, as a message sink takes them."""
    return events.select(F.col("subject").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"), F.col("type"))


def with_attempts(rejects: DataFrame, before: DataFrame | None, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rejects to be tried again, and those past their last attempt. before: key, attempts."""
    rows = rejects if before is None else rejects.join(before.select("key", F.col("attempts").alias("_n")), "key", "left")
    tries = (F.coalesce(F.col("_n"), F.lit(0)) if before is not None else F.lit(0)) + 1
    rows = rows.withColumn("attempts", tries).drop("_n")
    return rows.where(F.col("attempts") < most), rows.where(F.col("attempts") >= most)


def eval_report(rows: DataFrame, path: str) -> None:
    """An evaluation table as JSON lines."""
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; `limit` is the report's length."""
    data = rows.limit(limit).collect()
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in data])
