"""Readers of landed feeds, list responses, snapshots and registries. Spark reads files; fetching is another's work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "description", "content", "pubDate", "guid")])


def rss_items(spark: SparkSession, path: str, max_items: int = 100) -> DataFrame:
    """Items of RSS files in feed order, at most max_items of a file (the feed's own window): file, place, title, link, text
    (the longer of description and content), published. Items without a link are passed over."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "link", "description", "pubDate", "guid")] + [T.StructField("content:encoded", T.StringType())])
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).withColumnRenamed("content:encoded", "content")
    longer = F.when(F.length(F.coalesce("content", F.lit(""))) > F.length(F.coalesce("description", F.lit(""))), F.col("content")).otherwise(F.col("description"))
    from pyspark.sql import Window

    named = rows.select(F.input_file_name().alias("file"), "title", F.trim("link").alias("link"), longer.alias("text"), F.col("pubDate").alias("published"), F.monotonically_increasing_id().alias("_at"))
    w = Window.partitionBy("file").orderBy("_at")
    return named.where("link <> ''").withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_items).drop("_at")


def atom_items(spark: SparkSession, path: str, max_items: int = 100) -> DataFrame:
    """Entries of Atom files, as rss_items() gives RSS: the link is the first alternate one (no rel: alternate), published falls
    back to updated. Entries without such a link are passed over."""
    link = "array<struct<_href:string,_rel:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(f"title string, link {link}, summary string, content string, published string, updated string").load(path)
    from pyspark.sql import Window

    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    longer = F.when(F.length(F.coalesce("content", F.lit(""))) > F.length(F.coalesce("summary", F.lit(""))), F.col("content")).otherwise(F.col("summary"))
    named = rows.select(F.input_file_name().alias("file"), F.trim("title").alias("title"), F.trim(F.get(alternate, F.lit(0))["_href"]).alias("link"), longer.alias("text"), F.coalesce("published", "updated").alias("published"), F.monotonically_increasing_id().alias("_at"))
    w = Window.partitionBy("file").orderBy("_at")
    return named.where("link <> ''").withColumn("place", F.row_number().over(w)).where(F.col("place") <= max_items).drop("_at")


def json_feed_items(spark: SparkSession, path: str, max_items: int = 100) -> DataFrame:
    """Items of JSON Feed files, one document a file."""
    item = "struct<id:string,title:string,url:string,content_text:string,content_html:string,summary:string,date_published:string>"
    feed = spark.read.schema(f"title string, items array<{item}>").json(path, multiLine=True)
    rows = feed.select(F.input_file_name().alias("file"), F.posexplode(F.slice("items", 1, max_items)).alias("place", "i"))
    text = F.greatest(*[F.struct(F.length(F.coalesce(f"i.{c}", F.lit(""))).alias("n"), F.coalesce(f"i.{c}", F.lit("")).alias("t")) for c in ("content_text", "content_html", "summary")])["t"]
    return rows.select("file", (F.col("place") + 1).alias("place"), F.col("i.title").alias("title"), F.col("i.url").alias("link"), text.alias("text"), F.col("i.date_published").alias("published"))


def list_items(spark: SparkSession, path: str, seen: DataFrame | None = None) -> DataFrame:
    """Items of news lists (JSON lines): live stories with an outside URL, each id once, without those seen before."""
    rows = spark.read.schema("id bigint, type string, title string, url string, score int, descendants int, time bigint, by string, dead boolean, deleted boolean").json(path)
    live = rows.where("type = 'story' and url is not null and not coalesce(dead, false) and not coalesce(deleted, false)")
    once = live.groupBy("id").agg(F.max(F.struct("time", "title", "url", "score", "descendants", "by")).alias("x")).select("id", "x.*")
    return once if seen is None else once.join(seen.select("id"), "id", "left_anti")


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of search responses, one response a file; with its quota, so that a partial result shows."""
    rows = spark.read.schema("hits array<struct<objectID:string,title:string,points:int,created_at_i:bigint,story_text:string,author:string>>, quota_remaining int, error_message string").json(path, multiLine=True)
    warning = F.when(F.col("error_message").isNotNull(), F.col("error_message")).when(F.col("quota_remaining") == 0, "quota exhausted")
    return rows.select(F.explode_outer("hits").alias("h"), warning.alias("warning")).select("h.*", "warning")


def snapshot(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A frozen snapshot or label file: JSON lines, plain or gzip."""
    return spark.read.schema(schema).json(path)


def registry(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Source registries in YAML: `sources: [{id, kind, name, url, authority_prior, category}]`. A small dimension."""
    import yaml

    columns = "id string, kind string, name string, url string, authority_prior double, category string"
    rows = []
    for path in paths:
        for text in spark.read.text(path, wholetext=True).collect():  # registries are small files by nature
            for s in (yaml.safe_load(text[0]) or {}).get("sources", []):
                rows.append(tuple(float(s[c]) if c == "authority_prior" and s.get(c) is not None else s.get(c) for c in ("id", "kind", "name", "url", "authority_prior", "category")))
    return spark.createDataFrame(rows, columns)


def gazetteer_file(spark: SparkSession, path: str) -> list[tuple[str, list[str], bool]]:
    """Entities in YAML: `entities: [{id, aliases, case_sensitive}]`, as functions.text.gazetteer() takes them."""
    import yaml

    data = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) or {}
    return [(e["id"], list(e.get("aliases", [])), bool(e.get("case_sensitive", False))) for e in data.get("entities", [])]
