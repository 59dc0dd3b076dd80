"""Streams over file sources, readers and writers."""

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from storyloom.operators.ingest import checked
from storyloom.sources import readers, writers
from storyloom.streaming import stream

T0 = dt.datetime(2024, 1, 1)


def rows(n, start=0):
    return [(f"k{i % 7}", start + i, T0 + dt.timedelta(minutes=start + i), "a" if i % 2 else None) for i in range(n)]


SCHEMA = "key string, id long, ts timestamp, v string"


def test_sink_claims_each_key_once_over_batches_and_reruns(spark, tmp_path):
    source, at = f"{tmp_path}/in", {n: f"file://{tmp_path}/{n}" for n in ("good", "bad", "ledger", "cp")}
    frame = lambda n, s: spark.createDataFrame(rows(n, s), SCHEMA)
    frame(10, 0).coalesce(1).write.parquet(source)
    sink = stream.batch_sink(lambda b: checked(b, {"v": F.col("v").isNotNull()}), "key", ["id"], at["good"], at["bad"], at["ledger"])
    read = lambda: stream.event_stream(spark, source, frame(1, 0).schema)
    stream.drained(read(), sink, at["cp"])
    frame(10, 100).coalesce(1).write.mode("append").parquet(source)
    stream.drained(read(), sink, at["cp"])
    good = spark.read.parquet(at["good"])
    assert good.groupBy("key").count().where("count > 1").isEmpty() and good.count() == 5
    assert spark.read.parquet(at["bad"]).count() == 10
    before = sorted(map(str, good.collect()))
    sink(frame(10, 100), 1)  # the same batch again
    assert sorted(map(str, spark.read.parquet(at["good"]).collect())) == before


def test_windows_and_dedup(spark, tmp_path):
    source = f"{tmp_path}/in"
    data = spark.createDataFrame(rows(100) + rows(5), SCHEMA).withColumn("v", F.coalesce("v", F.lit("b")))
    data.write.parquet(source)
    read = lambda: stream.event_stream(spark, source, data.schema)
    counts = stream.counted_once(stream.hourly(read(), "ts", "v"), "hourly_test", f"file://{tmp_path}/a")
    assert sum(r.n for r in counts.collect()) == 105
    once = stream.counted_once(stream.deduplicated(read(), "id", "ts"), "dedup_test", f"file://{tmp_path}/b", "append")
    assert once.count() == 100
    s = stream.counted_once(stream.sessions(read(), "ts", "key"), "session_test", f"file://{tmp_path}/c", "complete")
    assert s.count() == 7
    pairs = stream.counted_once(stream.look_back(read(), read(), "key", "ts", 1), "pairs_test", f"file://{tmp_path}/d", "append")
    want = data.alias("a").join(data.alias("b"), F.expr("a.key = b.key and a.id <> b.id and b.ts between a.ts and a.ts + interval 1 hour"))
    assert pairs.count() == want.count()


def test_readers(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<rss><channel><item><title>A</title><link>https://x.com/a</link><description>short</description><guid>1</guid></item><item><title>B</title><link>https://x.com/b</link><description>much longer text</description></item></channel></rss>')
    items = {r.title: r.text for r in readers.rss_items(spark, f"file://{tmp_path}/f.xml").collect()}
    assert items == {"A": "short", "B": "much longer text"}
    (tmp_path / "feed.json").write_text(json.dumps({"title": "F", "items": [{"id": "1", "title": "x", "url": "u", "content_text": "ab", "summary": "abc"}]}))
    assert readers.json_feed_items(spark, f"file://{tmp_path}/feed.json").first().text == "abc"
    with gzip.open(tmp_path / "list.json.gz", "wt") as f:
        for x in ({"id": 1, "type": "story", "url": "u", "time": 1}, {"id": 1, "type": "story", "url": "u", "time": 2}, {"id": 2, "type": "story", "url": "u", "dead": True}, {"id": 3, "type": "job", "url": "u"}, {"id": 4, "type": "story", "url": "u"}):
            f.write(json.dumps(x) + "\n")
    path = f"file://{tmp_path}/list.json.gz"
    assert sorted(r.id for r in readers.list_items(spark, path).collect()) == [1, 4]
    assert [r.id for r in readers.list_items(spark, path, spark.createDataFrame([(1,)], "id long")).collect()] == [4]
    (tmp_path / "hits.json").write_text(json.dumps({"hits": [{"objectID": "9", "title": "t"}], "quota_remaining": 0}))
    hit = readers.search_hits(spark, f"file://{tmp_path}/hits.json").first()
    assert (hit.objectID, hit.warning) == ("9", "quota exhausted")
    (tmp_path / "r.yaml").write_text("sources:\n - {id: a, kind: rss, name: A, url: https://a, authority_prior: 1, category: press}\n")
    (tmp_path / "e.yaml").write_text("entities:\n - {id: go, aliases: [Go], case_sensitive: true}\n")
    assert readers.registry(spark, [f"file://{tmp_path}/r.yaml"]).first().authority_prior == 1.0
    assert readers.gazetteer_file(spark, f"file://{tmp_path}/e.yaml") == [("go", ["Go"], True)]


def test_writers(spark, tmp_path):
    texts = spark.createDataFrame([(1, "h", "a"), (1, "h", "a"), (2, "h", "b")], "doc_id long, content_hash string, text string")
    for _ in range(2):
        writers.store_texts(texts, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2
    events = spark.createDataFrame([("s", "t", T0)], "subject string, type string, time timestamp")
    writers.append_log(events, f"file://{tmp_path}/log")
    assert str(spark.read.parquet(f"file://{tmp_path}/log").first().date) == "2024-01-01"
    assert json.loads(writers.events_as_json(events).first().value)["subject"] == "s"
    again, dead = writers.with_attempts(spark.createDataFrame([("a",), ("b",)], "key string"), spark.createDataFrame([("a", 4)], "key string, attempts int"))
    assert [r.key for r in again.collect()] == ["b"] and [r.attempts for r in dead.collect()] == [5]
    assert writers.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n|---|---|\n| 1 |  |"


def test_feed_order_and_links(spark, tmp_path):
    days = ["Wed", "Fri", "Mon", "Tue"]  # as text, these sort otherwise than the feed does
    items = "".join(f"<item><title>t{i}</title><link>https://feed.test/{i}</link><pubDate>{days[i % 4]}, {i + 1} Jan 2024</pubDate></item>" for i in range(9))
    (tmp_path / "g.xml").write_text(f"<rss><channel><item><title>none</title></item><item><title>blank</title><link> </link></item>{items}</channel></rss>")
    got = sorted((r.place, r.title) for r in readers.rss_items(spark, f"file://{tmp_path}/g.xml", 5).collect())
    assert got == [(i + 1, f"t{i}") for i in range(5)]


def test_atom_entries_take_the_alternate_link_in_feed_order(spark, tmp_path):
    link = '<link rel="self" href="https://x.org/feed/1"/><link rel="alternate" type="text/html" href=" https://x.org/1 "/>'
    entries = (
        f"<entry><title>first</title>{link}<summary>short</summary><content>much longer</content><updated>2024-01-02T00:00:00Z</updated></entry>"
        '<entry><title>no page</title><link rel="enclosure" href="https://x.org/a.mp3"/></entry>'
        '<entry><title>plain</title><link href="https://x.org/2"/><summary>s</summary><published>2024-01-01T00:00:00Z</published><updated>2024-01-03T00:00:00Z</updated></entry>'
        '<entry><title>last</title><link href="https://x.org/3"/></entry>'
    )
    (tmp_path / "a.xml").write_text(f'<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><link href="https://x.org"/>{entries}</feed>')
    got = sorted((r.place, r.title, r.link, r.text, r.published) for r in readers.atom_items(spark, f"file://{tmp_path}/a.xml", 2).collect())
    assert got == [(1, "first", "https://x.org/1", "much longer", "2024-01-02T00:00:00Z"), (2, "plain", "https://x.org/2", "s", "2024-01-01T00:00:00Z")]
    (tmp_path / "none.xml").write_text("<feed/>")
    assert readers.atom_items(spark, f"file://{tmp_path}/none.xml").count() == 0
