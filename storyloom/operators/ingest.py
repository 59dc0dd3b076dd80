"""Ingestion: validation with rejects, idempotent claims, upserts, registries, discussion scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.checkpoints import cut
from storyloom.functions.text import collapse, excerpt, opening_text
from storyloom.functions.urls import canonical_url


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `errors`: the sorted names of the rules that a row breaks (a rule that is null is broken)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("errors", F.array_sort(F.array_compact(F.array(*broken))))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows without the errors, and rejects with them; nothing is dropped."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def parsed(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON lines as `event`, with errors for lines that don't parse and for unknown top-level fields."""
    rows = lines.withColumn("event", F.from_json(value, schema))
    keys = F.json_object_keys(value)
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    return checked(rows, {"json": keys.isNotNull(), "unknown_field": F.coalesce(F.size(F.array_except(keys, known)) == 0, F.lit(True))})


def document_kind(kind: Column, discussion: Column) -> Column:
    """A missing kind is an article; null where kind and discussion disagree."""
    k = F.coalesce(kind, F.lit("article"))
    return F.when((k == "article") & discussion.isNull() | (k == "discussion") & discussion.isNotNull(), k)


def envelope_rules() -> dict[str, Column]:
    """Rules for an extracted event in the column `event`."""
    e = lambda n: F.col(f"event.{n}")
    d = lambda n: F.col(f"event.data.{n}")
    sha = r"^[0-9a-f]{64}$"
    return {
        "subject": e("subject").rlike(sha),
        "idempotency_key": e("idempotency_key").rlike(sha),
        "time": e("time").isNotNull(),
        "title": F.length(d("title")).between(1, 500),
        "lede": F.length(d("lede")) <= 1000,
        "lang": d("lang").rlike("^[a-z]{2,3}$"),
        "content_origin": d("content_origin").isin("page", "feed"),
        "word_count": d("word_count") >= 0,
        "doc_kind": document_kind(d("doc_kind"), d("discussion")).isNotNull(),
    }


def claimed(events: DataFrame, key: str, order: list[str], ledger: DataFrame | None = None) -> DataFrame:
    """The first event of each key; keys that the ledger holds are passed over."""
    fresh = events if ledger is None else events.join(ledger.select(key), key, "left_anti")
    first = F.min_by(F.struct(*[c for c in events.columns if c != key]), F.struct(*order))
    return fresh.groupBy(key).agg(first.alias("e")).select(key, "e.*")


def upserted(rows: DataFrame, key: str, order: list[str], frozen: list[str]) -> DataFrame:
    """Per key: frozen columns from the first row, all others from the last one. One aggregate, no sort of the group."""
    place = F.struct(*order)
    others = [c for c in rows.columns if c != key and c not in frozen]
    return rows.groupBy(key).agg(F.min_by(F.struct(*frozen), place).alias("f"), F.max_by(F.struct(*others), place).alias("l")).select(key, "f.*", "l.*")


def mature(when: Column, now: Column, least_hours: int, most_hours: int) -> Column:
    """Whether an item's age lies between the two, read once when discussion has settled."""
    return (when > now - F.make_dt_interval(hours=F.lit(most_hours))) & (when < now - F.make_dt_interval(hours=F.lit(least_hours)))


def registry_errors(registry: DataFrame) -> DataFrame:
    """Every problem of every source: id, errors."""
    bounded = F.col("authority_prior").between(0.0, 1.0)
    rules = {"id": F.col("id").rlike("^[a-z0-9][a-z0-9-]{0,63}$"), "url": F.col("url").startswith("https://"), "authority_prior": bounded, "kind": F.col("kind").isin("rss", "hn", "github", "lobsters", "stackexchange")}
    twice = registry.groupBy("id").agg(F.count("*").alias("n"))
    return checked(registry.join(twice, "id"), rules | {"duplicate_id": F.col("n") == 1}).select("id", "errors").where(F.size("errors") > 0)


def synced_registry(current: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts new sources; ids that are in no file are disabled, never deleted."""
    c, n = current.alias("c"), new.alias("n")
    columns = [x for x in new.columns if x not in ("id", "enabled")]
    known = c.join(n, F.col("c.id") == F.col("n.id"), "full_outer")
    return known.select(F.coalesce("n.id", "c.id").alias("id"), *[F.when(F.col("n.id").isNotNull(), F.col(f"n.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in columns], F.col("n.id").isNotNull().alias("enabled"))


def thread_comments(comments: DataFrame, floor: int, per_thread: int = 3) -> DataFrame:
    """Of threads whose post has the points: the top-level comments with most replies below them (ties: smaller id).

    comments: thread_id, id, parent_id, points (of the post, on the post's row). Replies are counted level by level: each
    round every row hands itself to its parent's parent, until only posts are left, so rounds are as many as levels.
    """
    level = comments.where("parent_id is not null").select("thread_id", F.col("id").alias("above"), F.col("parent_id").alias("next"))
    parents = comments.select(F.col("id").alias("next"), F.col("parent_id").alias("beyond"))
    counted = None
    while True:
        level = cut(level, "level")
        if level.isEmpty():
            break
        part = level.groupBy("thread_id", F.col("above").alias("id")).agg(F.count("*").alias("n"))
        counted = part if counted is None else counted.unionByName(part)
        level = level.join(parents, "next").where("beyond is not null").select("thread_id", F.col("next").alias("above"), F.col("beyond").alias("next"))
    if counted is None:
        counted = comments.sparkSession.createDataFrame([], "thread_id long, id long, n long")
    below = counted.groupBy("thread_id", "id").agg((F.sum("n") - 1).alias("replies"))
    posts = comments.where("parent_id is null").where(F.col("points") >= floor).select("thread_id", F.col("id").alias("post_id"))
    heads = comments.join(posts, "thread_id").where(F.col("parent_id") == F.col("post_id")).select("thread_id", "id")
    w = Window.partitionBy("thread_id").orderBy(F.desc("replies"), "id")
    return heads.join(below, ["thread_id", "id"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_thread)


def issues(rows: DataFrame) -> DataFrame:
    """Issues without pull requests and bot authors, HTML comments taken out of the body."""
    kept = rows.where(~F.coalesce("is_pull_request", F.lit(False)) & ~F.coalesce(F.col("author").endswith("[bot]"), F.lit(False)))
    return kept.withColumn("body", collapse(F.regexp_replace("body", r"(?s)<!--.*?-->", " "))).withColumn("text", opening_text(F.col("title"), F.col("body")))


def packed_queries(repos: list[str], prefix: str, limit: int = 256) -> list[str]:
    """Search strings of at most `limit` characters that name all repositories."""
    out, line = [], prefix
    for repo in repos:
        part = f" repo:{repo}"
        if len(line) + len(part) > limit and line != prefix:
            out.append(line)
            line = prefix
        line += part
    return out + [line] if line != prefix else out


def tagged_items(lists: list[DataFrame], floor: int, now: Column, least_hours: int, most_hours: int) -> DataFrame:
    """Union of tag lists, each id once, mature, with the score; best first (ties: smaller id)."""
    out = lists[0]
    for one in lists[1:]:
        out = out.unionByName(one)
    one_each = out.groupBy("id").agg(F.max(F.struct("score", "created_at", "title")).alias("x")).select("id", "x.*")
    return one_each.where((F.col("score") >= floor) & mature(F.col("created_at"), now, least_hours, most_hours)).orderBy(F.desc("score"), "id")


def feed_document(title: Column, content: Column, url: Column) -> Column:
    """The fallback document of a feed item, null where title or text are too poor."""
    text = collapse(F.regexp_replace(content, "<[^>]*>", " "))
    good = (F.length(F.trim(title)) > 0) & (F.length(text) >= 80)
    return F.when(good, F.struct(F.left(title, F.lit(500)).alias("title"), text.alias("text"), excerpt(text, 1000).alias("lede"), canonical_url(url).alias("canonical_url"), F.lit("feed").alias("content_origin")))


def page_document(html: Column) -> Column:
    """Main content by block rules: script, style, nav, header, footer, aside and comments go, then the tags of the rest."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside|form|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    main = F.regexp_extract(body, r"(?is)<(article|main)\b[^>]*>(.*)</\1\s*>", 2)
    paragraphs = F.regexp_replace(F.when(main == "", body).otherwise(main), r"(?is)<title\b.*?</title\s*>", " ")
    from storyloom.functions.text import strip_tags

    text = strip_tags(paragraphs)
    return F.struct(strip_tags(title).alias("title"), text.alias("text"), F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).alias("word_count"), F.sha2(text, 256).alias("content_hash"))
