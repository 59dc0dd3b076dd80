"""Duplicates and clusters: exact copies, LSH candidates, pair features, components, ordered replay."""

from __future__ import annotations

import math
from collections import OrderedDict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom import fixed
from storyloom.checkpoints import cut
from storyloom.functions import text as tx
from storyloom.functions.hashing import band_keys, estimated_jaccard, minhash
from storyloom.functions.vectors import arrays
from storyloom.operators.problems import join_probability


def content_duplicates(articles: DataFrame) -> DataFrame:
    """id, duplicate_of: the first article by (discovered_at, id) with the same content, null for the first itself."""
    first = articles.groupBy("content_hash").agg(F.min(F.struct("discovered_at", "id")).alias("f"))
    rows = articles.select("id", "content_hash").join(first, "content_hash")
    return rows.select("id", F.when(F.col("f.id") != F.col("id"), F.col("f.id")).alias("duplicate_of"))


def signatures(articles: DataFrame) -> DataFrame:
    """id, signature, bands of the articles that are no copies (a copy joins its original without scoring)."""
    originals = articles.join(content_duplicates(articles).where("duplicate_of is null").select("id"), "id", "left_semi")
    shingled = originals.select("id", tx.content_tokens(F.col("body")).alias("t")).select("id", tx.shingles(F.col("t")).alias("shingles"))
    return minhash(shingled, "id", "shingles").withColumn("bands", band_keys(F.col("signature")))


def lsh_pairs(signed: DataFrame, times: DataFrame, window_hours: int = 72) -> DataFrame:
    """a < b that share a band and were discovered within window_hours of each other; with the estimated Jaccard.

    The later of a pair, by time and id, meets the earlier ones, as in a replay, whichever id is smaller. Buckets by
    (band, window) with the neighbouring window make the time range an equi-join; only ids and times move until the
    distinct pairs are known.
    """
    rows = signed.join(times.select("id", "discovered_at"), "id").select("id", F.unix_micros("discovered_at").alias("t"), F.explode("bands").alias("band"))
    window = window_hours * 3_600_000_000
    slot = F.floor(F.col("t") / window)
    left = rows.select(F.col("id").alias("x"), F.col("t").alias("tx"), "band", slot.alias("slot"))
    right = rows.select(F.col("id").alias("y"), F.col("t").alias("ty"), "band", F.explode(F.array(slot, slot - 1)).alias("slot"))
    near = (F.struct("tx", "x") < F.struct("ty", "y")) & (F.col("ty") - F.col("tx") <= window)
    pairs = left.join(right, ["band", "slot"]).where(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    s = signed.select("id", "signature")
    both = pairs.join(s.toDF("a", "sa"), "a").join(s.toDF("b", "sb"), "b")
    return both.select("a", "b", estimated_jaccard(F.col("sa"), F.col("sb")).alias("jaccard"))


def pair_scores(pairs: DataFrame, articles: DataFrame, vectors: DataFrame, scorer: dict[str, float] = fixed.STORY_SCORER) -> DataFrame:
    """Features and join probability of each pair; a missing embedding has cosine -1. vectors: id, v."""
    from storyloom.functions.vectors import cosine

    side = articles.join(vectors, "id", "left").select("id", tx.content_tokens(F.col("title")).alias("t"), tx.version_tokens(F.col("title")).alias("ver"), "source_id", "discovered_at", "v")
    x, y = (side.select([F.col(c).alias(f"{c}_{k}") for c in side.columns]) for k in "ab")
    rows = pairs.join(x, pairs["a"] == x["id_a"]).join(y, pairs["b"] == y["id_b"])
    conflict = (F.size("ver_a") > 0) & (F.size("ver_b") > 0) & ~F.arrays_overlap("ver_a", "ver_b")
    found = rows.select(
        "a", "b",
        F.coalesce(cosine(F.col("v_a"), F.col("v_b")), F.lit(-1.0)).alias("max_member_cosine"),
        F.lit(0.0).alias("centroid_cosine"), F.col("jaccard").alias("minhash_jaccard"),
        tx.jaccard(F.array_distinct("t_a"), F.array_distinct("t_b")).alias("title_jaccard"), F.lit(0.0).alias("entity_jaccard"),
        (F.abs(F.unix_micros("discovered_at_b") - F.unix_micros("discovered_at_a")) / F.lit(3.6e9)).alias("hours_gap"),
        (F.col("source_id_a") == F.col("source_id_b")).cast("int").alias("same_source"), conflict.cast("int").alias("version_conflict"),
    )
    return join_probability(found, scorer)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label (the smallest id reachable). Labels spread along edges and then jump to their label's label, so rounds
    grow with the logarithm of a chain's length; each round ends in a written table."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        heard = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("l"))
        spread = labels.join(heard, "id", "left").select("id", F.col("label").alias("before"), F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = spread.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        after = cut(spread.join(jump, "label", "left").select("id", "before", F.least("label", F.coalesce("beyond", "label")).alias("label")), "labels")
        changed = not after.where("label <> before").isEmpty()
        labels = after.select("id", "label")
        if not changed:
            return labels


def story_components(articles: DataFrame, links: DataFrame) -> DataFrame:
    """id, story_id: exact copies and linked articles share a story, named by its smallest id. links: a, b."""
    copies = content_duplicates(articles).where("duplicate_of is not null").select(F.col("duplicate_of").alias("a"), F.col("id").alias("b"))
    return components(articles.select("id"), links.select("a", "b").unionByName(copies)).select("id", F.col("label").alias("story_id"))


def replay(articles: DataFrame, scorer: dict[str, float] = fixed.STORY_SCORER, window_hours: int = 72, nearest: int = 10, compared: int = 25) -> DataFrame:
    """Online assignment in order of (discovered_at, id): id, story_id, probability.

    A copy joins its original's story at once. Others meet the stories with the nearest centroids or a shared band
    within the window, are scored against the newest members, and join the best one at or above the threshold (ties:
    the larger story id). A vector with null or non-finite components, or of another length than the first, counts as
    none; rows without a time come last and meet no story.

    Each row's outcome needs those before it, so the rows pass through one task, in order and a batch at a time. The task
    keeps the stories of the window, and of older ones those of whose texts copies are still to come; how often texts
    and bands occur is counted before. A row costs the stories in its window, whatever came before them. ids are
    unique. articles: id, discovered_at, source_id, content_hash, title tokens `t`, versions `ver`, bands, signature,
    vector `v`.
    """
    rows = articles.select(
        F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.unix_micros("discovered_at").alias("at"), "source_id", "content_hash", "t", "ver",
        "bands", "signature", F.col("v").cast("array<double>").alias("v"),
    )
    rows = cut(rows, "replay")
    copies = rows.groupBy("content_hash").agg(F.count("*").alias("copies")).where("copies > 1").withColumnRenamed("content_hash", "copied")
    band = rows.select("row", F.explode(F.array_distinct("bands")).alias("band"))
    again = band.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = band.join(again, "band").groupBy("row").agg(F.collect_list("band").alias("bands"), F.collect_list("rows").alias("rows"))
    rows = rows.drop("bands").join(copies, F.col("content_hash").eqNullSafe(F.col("copied")), "left").join(shared, "row", "left")
    ordered = rows.repartition(1).sortWithinPartitions(F.asc_nulls_last("at"), F.asc_nulls_last("id"), "content_hash", "row")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Replay(scorer, window_hours * 3_600_000_000, nearest, compared)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "at", "source_id", "content_hash", "t", "ver", "copies", "bands", "rows")]
            signature, v = (arrays(batch.column(c), kind) for c, kind in (("signature", np.int64), ("v", np.float64)))
            out = [state.add(*row) for row in zip(*columns, signature, v)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.float64())], ["id", "story_id", "probability"])

    return ordered.mapInArrow(assign, "id long, story_id long, probability double")


class Story:
    """id, the newest members (source, versions, signature, vector), how many there are, the centroid and its place, the
    first title's tokens, the last time, bands that are still to come, and texts with copies still to come."""

    __slots__ = ("bands", "centre", "id", "last", "members", "n", "place", "texts", "title")

    def __init__(self, id_: int | None, title: frozenset, compared: int) -> None:
        self.id, self.title, self.members, self.n = id_, title, deque(maxlen=compared), 0
        self.centre, self.place, self.last, self.bands, self.texts = None, -1, None, set(), 0


class Replay:
    """What replay() has to remember. Stories are `live`, in order of their last time, or `asleep`: out of the window, but
    of a text with copies to come."""

    def __init__(self, scorer: dict[str, float], window: int, nearest: int, compared: int) -> None:
        self.scorer, self.window, self.nearest, self.compared = scorer, window, nearest, compared
        self.live: OrderedDict[float, Story] = OrderedDict()
        self.asleep: dict[float, Story] = {}
        self.texts: dict[str | None, list] = {}  # story, copies to come
        self.bands: dict[str, list] = {}  # keys of live stories, rows to come
        self.centres, self.keys = np.zeros((64, 0)), []  # of the live stories with a centroid

    def add(self, id_, at, source, text, title, ver, copies, bands, rows, signature, v) -> tuple[int | None, float | None]:
        """story_id and probability of the next row."""
        while self.live and (at is None or at - next(iter(self.live.values())).last > self.window):
            self._sleep(next(iter(self.live)))
        bands = list(zip(bands or (), rows or ()))
        if known := self.texts.get(text):
            key, known[1] = known[0], known[1] - 1
            story = self.live.get(key) or self.asleep[key]
            if not known[1]:
                del self.texts[text]
                story.texts -= 1
            for band, n in bands:
                self._pass(band, n, None)
            if at is not None:
                self._touch(key, story, at)
            elif not story.texts:
                self.asleep.pop(key, None)
            return story.id, None
        v = self._unit(v)
        tokens, versions = frozenset(title or ()), frozenset(ver or ())
        key, p = self._best(at, source, tokens, versions, bands, signature, v) or (math.nan if id_ is None else id_, None)
        story = self.live.get(key) or self.asleep.get(key) or Story(id_, tokens, self.compared)
        if v is not None:
            total = v if story.centre is None else story.centre * story.n + v
            story.centre = total / max(np.linalg.norm(total), 1e-12)
        story.members.append((source, versions, signature, v))
        story.n += 1
        if copies:
            self.texts[text] = [key, copies - 1]
            story.texts += 1
        if at is None:
            self.asleep[key] = story
            if not story.texts:
                del self.asleep[key]
        else:
            self._touch(key, story, at)
        for band, n in bands:
            self._pass(band, n, key if at is not None else None)
        return story.id, p

    def _unit(self, v: np.ndarray | None) -> np.ndarray | None:
        if v is None or not np.isfinite(v).all():
            return None
        if not self.centres.shape[1]:
            self.centres = np.zeros((len(self.centres), len(v)))
        if len(v) != self.centres.shape[1] or not len(v):
            return None
        return v / length if (length := np.linalg.norm(v)) > 0 else v

    def _best(self, at, source, tokens, versions, bands, signature, v) -> tuple[float, float] | None:
        """Key and probability of the story to join."""
        if at is None:
            return None
        met = {k for band, _ in bands if band in self.bands for k in self.bands[band][0]}
        if v is not None and self.keys:
            met.update(self._close(v))
        s, best = self.scorer, None
        for k in met:
            story = self.live[k]
            cosine, same, source_seen, theirs = None, 0.0, False, set()
            for m_source, m_versions, m_signature, m_v in story.members:
                if v is not None and m_v is not None:
                    c = float(v @ m_v)
                    cosine = c if cosine is None or c > cosine else cosine
                if signature is not None and m_signature is not None:
                    same = max(same, float(np.mean(signature == m_signature)))
                source_seen = source_seen or m_source == source
                theirs |= m_versions
            values = {
                "minhash_jaccard": same,
                "title_jaccard": len(tokens & story.title) / len(tokens | story.title) if tokens and story.title else 0.0,
                "hours_gap": abs((at - story.last) / 1e6) / 3600,
                "same_source": float(source_seen),
                "version_conflict": float(bool(versions) and bool(theirs) and not versions & theirs),
            }
            z = s["intercept"] + s["max_member_cosine"] * ((-1.0 if cosine is None else cosine) - s["cosine_center"])
            z += sum(s[n] * x for n, x in values.items())
            found = 1 / (1 + np.exp(-min(max(z, -50.0), 50.0))), k
            best = found if best is None else max(best, found)
        return (best[1], float(best[0])) if best and best[0] >= s["threshold"] else None

    def _close(self, v: np.ndarray) -> list[float]:
        """The nearest centroids: one product names those that may be, each is then taken by itself, which does not depend
        on its place."""
        n = len(self.keys)
        if n <= self.nearest:
            return self.keys
        near = self.centres[:n] @ v
        some = np.flatnonzero(near >= np.partition(near, n - self.nearest)[n - self.nearest] - 1e-9).tolist()
        return [k for _, k in sorted((-float(v @ self.live[self.keys[i]].centre), self.keys[i]) for i in some)[: self.nearest]]

    def _touch(self, key: float, story: Story, at: int) -> None:
        """The story's last time is now, and its centroid has changed."""
        if key not in self.live:
            self.asleep.pop(key, None)
            self.live[key] = story
            story.bands = {b for b in story.bands if b in self.bands}
            for band in story.bands:
                self.bands[band][0].add(key)
        self.live.move_to_end(key)
        story.last = at
        if story.centre is not None:
            if story.place < 0:
                story.place = len(self.keys)
                self.keys.append(key)
                if len(self.keys) > len(self.centres):
                    self.centres = np.concatenate([self.centres, np.zeros_like(self.centres)])
            self.centres[story.place] = story.centre

    def _sleep(self, key: float) -> None:
        story = self.live.pop(key)
        for band in story.bands:
            self.bands[band][0].discard(key)
        if story.place >= 0:  # the last place's story moves here
            moved = self.keys.pop()
            if moved != key:
                self.keys[story.place], self.live[moved].place = moved, story.place
                self.centres[story.place] = self.live[moved].centre
            story.place = -1
        if story.texts:
            self.asleep[key] = story

    def _pass(self, band: str, n: int, key: float | None) -> None:
        """One of the n rows with the band has been, and was put into the story."""
        keys = self.bands.setdefault(band, [set(), n])
        keys[1] -= 1
        if not keys[1]:
            for k in self.bands.pop(band)[0]:
                self.live[k].bands.discard(band)
        elif key is not None:
            keys[0].add(key)
            self.live[key].bands.add(band)
