"""Explicit schemas, table loaders, and the domain views that the driver's tables give.

Columns that the tables don't hold are synthetic: the arithmetic below makes them, and says nothing about the world.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.functions.text import collapse

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SIGNALS = struct(hn_item_id=L, hn_points=I, hn_comments=I, observed_at=TS)
ENGAGEMENT = struct(points=I, comments=I, reactions=I)
DISCUSSION = struct(platform=S, thread_url=S, parent_url=S, author_hash=S, engagement=ENGAGEMENT)
EXTRACTED = struct(
    article_id=S, canonical_url=S, final_url=S, source_id=S, title=S, lede=S, text_uri=S, content_hash=S, lang=S, word_count=I,
    content_origin=S, published_at=TS, discovered_at=TS, extracted_at=TS, signals=SIGNALS, doc_kind=S, discussion=DISCUSSION,
)
DISCOVERED = struct(
    article_id=S, url=S, canonical_url=S, source_id=S, discovered_at=TS, published_at=TS, feed_title=S, feed_summary=S,
    signals=SIGNALS, doc_kind=S, discussion=DISCUSSION,
)


def envelope(data: T.StructType) -> T.StructType:
    return struct(id=S, type=S, source=S, subject=S, time=TS, schema_version=I, idempotency_key=S, caused_by=S, data=data)


#: Tables whose rows take long: texts.
LONG = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt to all cores first; a large one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in LONG else df


#: Seconds of 2024-01-01 00:00 UTC.
START = 1_704_067_200


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, its story the smallest id of equal content."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("body", collapse(F.col("text")))
    i = F.col("doc_id")
    discovered = F.timestamp_seconds(START + i * 420)
    d = d.select(
        i.alias("id"), "lang", F.col("source").alias("source_id"), "body", discovered.alias("discovered_at"),
        F.left("body", F.lit(160)).alias("title"), F.left("body", F.lit(1000)).alias("lede"), F.sha2("body", 256).alias("content_hash"),
        F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", " "))).alias("word_count"),
        F.when(i % 3 == 0, "feed").otherwise("page").alias("content_origin"),
        F.when(i % 4 == 0, i * 37 % 500).alias("hn_points"), F.when(i % 4 == 0, i * 13 % 90).alias("hn_comments"),
    )
    published = F.timestamp_seconds(F.unix_timestamp("discovered_at") - F.col("id") % 49 * 3600)
    return d.withColumn("published_at", F.when(F.col("id") % 11 != 0, published))


def articles_with_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles() with story_id by exact content. Equal content is one group of any size: the smallest id is
    pre-aggregated and joined back, and adaptive execution splits a hot one."""
    a = articles(spark, sf_dir)
    first = a.groupBy("content_hash").agg(F.min("id").alias("story_id"))
    return a.join(first, "content_hash")


def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct sources, with an authority and a category from the number in their names."""
    names = table(spark, sf_dir, "documents").where(F.col("source").isNotNull()).select(F.col("source").alias("source_id")).distinct()
    n = F.coalesce(F.regexp_extract("source_id", r"(\d+)$", 1).try_cast("int"), F.lit(0))
    category = F.element_at(F.array(*[F.lit(c) for c in ("primary", "press", "independent", "community")]), n % 4 + 1)
    return names.select("source_id", (F.lit(0.5) + F.lit(0.02) * (n % 20)).alias("authority_prior"), category.alias("category"), (n % 10 != 9).alias("enabled"))


def discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn 0 of a conversation is a post, later turns are its comments; five conversations make a problem.

    A turn's problem probability is synthetic; those from one half on are admitted to the problem.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    thread, turn = F.col("conv_id"), F.col("turn")
    later = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    p = (thread * 7 + turn * 13) % 100 / F.lit(100.0)
    pick = lambda words, k: F.element_at(F.array(*[F.lit(w) for w in words]), (k + 1).cast("int"))
    return c.join(later, "conv_id").select(
        (thread * 100 + turn).alias("id"), thread.alias("thread_id"), "turn", (turn > 0).alias("is_comment"), collapse(F.col("text")).alias("body"),
        pick(("hn", "github", "lobsters", "stackexchange"), thread % 4).alias("platform"),
        F.concat(F.lit("forum"), (thread % 9).cast("string")).alias("source_id"),
        F.when((thread + turn) % 13 != 0, F.concat("role", F.lit("-"), (thread % 37).cast("string"))).alias("author_hash"),
        F.timestamp_seconds(START + thread * 660 + turn * 60).alias("observed_at"),
        ((thread * 31 + turn) % 60 - 5).alias("points"), (F.col("last") - turn).alias("comments"), F.when(turn == 0, thread % 8).alias("reactions"),
        p.alias("p_problem"),
        pick(("bug_or_reliability", "cost_or_performance", "missing_capability", "workflow_friction"), (thread + turn) % 4).alias("category"),
        F.when(p >= 0.5, F.floor(thread / 5)).alias("problem_id"),
    )


def as_of(spark: SparkSession, sf_dir: str) -> F.Column:
    """The latest discovery, as a literal: never the wall clock. One aggregate over the ids."""
    last = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    return F.timestamp_seconds(F.lit(START + last * 420))
