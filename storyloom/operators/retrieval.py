"""Retrieval: postings, BM25, boolean AND, nearest neighbours, rank fusion, rerank features and tree ensembles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom import fixed
from storyloom.checkpoints import cut
from storyloom.functions import text as tx
from storyloom.functions.vectors import dots, in_order, padded

#: Depth of each retrieval list, and the constant of rank fusion.
DEPTH, FUSION = 200, 60
#: Terms of queries that are broadcast at most.
QUERY_TERMS = 200_000


def tokenized(articles: DataFrame) -> DataFrame:
    """id, terms (of the title twice and the body once), length: the one pass of the tokenizer. Written, it serves
    postings() and corpus_size() both."""
    t = articles.select("id", tx.content_tokens(F.col("title")).alias("t"), tx.content_tokens(F.col("body")).alias("b"))
    return t.select("id", F.concat("t", "t", "b").alias("terms")).withColumn("length", F.size("terms"))


def _tokenized(articles: DataFrame) -> DataFrame:
    return articles if "terms" in articles.columns else tokenized(articles)


def postings(articles: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """term, id, tf, length of the document in terms. articles: tokenized(), or what it takes. One shuffle by (term, id)
    after a partial count. With queries only their terms, dealt by id, so that bm25() sums where they are counted."""
    rows = tx.exploded(_tokenized(articles).select("id", "length", "terms"), "terms", "term")
    if queries is not None:
        rows = rows.join(query_terms(queries).select("term").distinct(), "term").repartition("id")
    return rows.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """qid, term, n_terms: the distinct content tokens of each query."""
    q = queries.select("qid", F.array_distinct(tx.content_tokens(F.col("text"))).alias("terms"))
    return tx.exploded(q.withColumn("n_terms", F.size("terms")), "terms", "term")


def bm25(index: DataFrame, corpus: DataFrame, queries: DataFrame, depth: int | None = DEPTH, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """qid, id, score, matched, rank. index: postings(); corpus: one row with n and mean_length. Without a depth all
    scored rows come, with no rank.

    Document frequencies are joined to the query's terms; the postings meet both in one equi-join on the term, a
    broadcast of at most QUERY_TERMS rows, and are summed with partial aggregation. Scores are rounded before they rank.
    """
    terms = query_terms(queries)
    wanted = terms.select("term").distinct()
    live = index.join(wanted, "term")
    df = live.groupBy("term").agg(F.count("*").alias("df"))
    size = corpus.first()
    n, mean = (size["n"] or 0), (size["mean_length"] or 1.0)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    asked = terms.join(df, "term")
    asked = F.broadcast(asked) if terms.count() <= QUERY_TERMS else asked
    scored = live.join(asked, "term").groupBy("qid", "id", "n_terms").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))
    return scored if depth is None else top(scored, "qid", "score", "id", depth)


def corpus_size(articles: DataFrame) -> DataFrame:
    """n and mean_length over all documents, those without terms included."""
    return _tokenized(articles).select("length").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))


def top(rows: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best of each key; the window's group limit drops the rest before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match_all(scored: DataFrame) -> DataFrame:
    """Of bm25() rows with all of the query's terms, ranked anew; rank/(rank+1)-style scores keep the order."""
    full = scored.where(F.col("matched") == F.col("n_terms")).drop("rank")
    return top(full.withColumn("score", F.round(F.col("score") / (F.col("score") + 1), 6)), "qid", "score", "id", DEPTH)


#: Queries of a block; a block is broadcast, and the vectors are scanned once for each.
QUERY_BLOCK = 2_000
#: Similarities have six places; how near to half of the last one it is left to exact sums which way they are rounded.
PLACES, MARGIN = 1e6, 1e-4
#: Pairs that are scored at once; pairs of a task.
TILE, TASK_PAIRS = 1 << 21, 40_000_000
#: What stands for a null similarity, which is less than any other. NaN, which is more, is infinite.
NULL = -1e308


class QueryBlock:
    """A block of queries as matrices."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by("qid").combine_chunks()
        self.qid = rows["qid"].to_numpy()
        self.x, self.size = padded(rows["q"])
        self.usual = np.bincount(self.size[self.size >= 0]).argmax() if (self.size >= 0).any() else 0
        self.norm, self.unit, self.odd = self.units(self.x, self.size)

    def units(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Norms, vectors of length one, and for which vectors their product is no similarity: those with null
        components, another length, or a norm so large or small that sums depend on their order."""
        with np.errstate(all="ignore"):
            n = np.sqrt(dots(x, x))
            odd = (size < 0) | ((n != 0) & ((size != self.usual) | ~((n > 1e-100) & (n < 1e100))))
            return n, np.where(((n == 0) | odd)[:, None], 0.0, x / n[:, None]), odd

    def exact(self, product: np.ndarray, n: np.ndarray, size: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Similarities with queries c, from products that were summed in order of the components, as SQL expressions do."""
        with np.errstate(all="ignore"):
            length = n * self.norm[c]
            s = np.where(length == 0, 0.0, product / length)
        s[np.isnan(s)] = np.inf
        s[(size < 0) | (self.size[c] < 0) | ((size != self.size[c]) & (length != 0))] = NULL
        return s

    def rounded(self, s: np.ndarray, x: np.ndarray, n: np.ndarray, size: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The similarities s of vectors x with queries c to six places, half up like SQL's. Only near a half their
        exact sums are taken; a half is the double next to it, as a double's shortest decimal says."""
        with np.errstate(all="ignore"):
            u = np.abs(s) * PLACES
            whole = np.floor(u)
            up = u - whole > 0.5
            o = np.flatnonzero(np.abs(u - whole - 0.5) < MARGIN)
            near = self.exact(dots(x[o], self.x[c[o]]), n[o], size[o], c[o])
            up[o] = np.abs(near) >= (10 * whole[o] + 5) / (10 * PLACES)
            return np.where(np.abs(s) < 1e300, np.sign(s) * (whole + up) / PLACES + 0.0, s)

    def best(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """Of each query with rows to meet its k best, as structs of the negative similarity and the id. batches: id and
        vector, in order of the ids. What is kept are the k best so far and as many pairs again that may be among them."""
        m = len(self.qid)
        most, step = max(1, TILE // m), k + 1
        bar, parts, waiting = np.full(m, -np.inf), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, (x, size) = batch.column(0).to_numpy(), padded(batch.column(1))
            x, width = np.pad(x, ((0, 0), (0, max(0, self.x.shape[1] - x.shape[1])))), x.shape[1]
            if width > self.x.shape[1]:
                self.x, self.unit = (np.pad(y, ((0, 0), (0, width - y.shape[1]))) for y in (self.x, self.unit))
            n, unit, odd = self.units(x, size)
            low, high = np.searchsorted(self.qid, ids), np.searchsorted(self.qid, ids, "right")
            a = 0
            while a < len(ids):
                z, step = min(len(ids), a + min(step, most)), min(2 * step, most)
                s = unit[a:z] @ self.unit.T
                for r, c in ((np.flatnonzero(odd[a:z]), np.arange(m)), (np.arange(z - a), np.flatnonzero(self.odd))):
                    if len(r) and len(c):
                        s[np.ix_(r, c)] = self.exact(in_order(x[a:z][r], self.x[c]), n[a:z][r, None], size[a:z][r, None], c)
                for r in np.flatnonzero(low[a:z] < high[a:z]):
                    s[r, low[a + r] : high[a + r]] = -np.inf  # itself
                r, c = np.divmod(np.flatnonzero(s > bar), m)
                s = self.rounded(s[r, c], x[a:z][r], n[a:z][r], size[a:z][r], c)
                parts.append((c.astype(np.min_scalar_type(m)), -s, ids[a:z][r]))
                waiting += len(r)
                if waiting > max(m * k, TILE // 8):
                    parts, waiting = [self.cut_down(parts, k, bar)], 0
                a = z
        if parts:
            c, s, ids = self.cut_down(parts, k, bar)
            bounds = np.searchsorted(c, np.arange(m + 1))
            some = np.flatnonzero(np.diff(bounds))
            lists = pa.ListArray.from_arrays(pa.array(bounds[[*some, m]], pa.int32()), pa.StructArray.from_arrays([pa.array(s), pa.array(ids)], ["s", "id"]))
            yield pa.RecordBatch.from_arrays([pa.array(self.qid[some]), lists], ["qid", "best"])

    def cut_down(self, parts: list[tuple[np.ndarray, ...]], k: int, bar: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k best of each query, in order. What comes later has a larger id, so that it must be rounded to more than
        the last of the k; that raises the bar."""
        c, s, ids = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((s, c))
        c = c[order]
        first = np.searchsorted(c, np.arange(len(bar)))
        keep = np.arange(len(c)) - first[c] < k
        order, c = order[keep], c[keep]
        s, ids = s[order], ids[order]
        last = np.searchsorted(c, np.arange(len(bar)), "right") - 1
        full = np.bincount(c, minlength=len(bar)) == k
        bar[full] = -s[last[full]] + (0.5 - MARGIN) / PLACES
        return c, s, ids


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine neighbours: qid, id, similarity, rank. queries: qid and vector `q`.

    The stated queries meet all other rows, as matrix products in Arrow tasks: queries in blocks of about QUERY_BLOCK, each
    sent to the tasks once; a task keeps the k best of a query and sends them as one row. Tasks are no more than
    keep all cores busy, since each adds k rows a query. A cosine with a zero vector is 0; with one that has null
    components or another length it is null, which is less than any other; NaN is more. Ties: smaller id.
    """
    spark = vectors.sparkSession
    known = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    asked = cut(queries.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).where("qid is not null and q is not null"), "queries")
    n = asked.count()
    blocks = -(-n * 5 // (4 * QUERY_BLOCK)) if n > QUERY_BLOCK else 1
    tasks = min(-(-n * known.count() // (blocks * TASK_PAIRS)), -(-4 * spark.sparkContext.defaultParallelism // blocks))
    dealt = known.repartition(max(1, tasks)).sortWithinPartitions("id")
    lists = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow()
        if not rows.num_rows:
            continue

        def meet(batches: Iterator[pa.RecordBatch], block: QueryBlock = QueryBlock(rows)) -> Iterator[pa.RecordBatch]:
            return block.best(batches, k)

        part = dealt.mapInArrow(meet, "qid long, best array<struct<s: double, id: long>>")
        lists = part if lists is None else lists.unionByName(part)
    if lists is None:
        return spark.createDataFrame([], "qid long, id long, similarity double, rank int")
    merged = lists.groupBy("qid").agg(F.flatten(F.collect_list("best")).alias("best"))
    places = merged.select("qid", F.posexplode(F.slice(F.sort_array("best"), 1, k)).alias("at", "x"))
    s = F.col("x.s")
    similarity = F.when(s == -NULL, F.lit(None)).when(s == float("-inf"), float("nan")).otherwise(0.0 - s)
    return places.select("qid", "x.id", similarity.cast("double").alias("similarity"), (F.col("at") + 1).alias("rank"))


def fused(lists: list[DataFrame], k: int = FUSION) -> DataFrame:
    """Reciprocal rank fusion of lists with qid, id, rank: a repeated id counts once, at its first place.

    Keeps the place in each list as rank_0, rank_1, ... for ties."""
    rows = None
    for i, one in enumerate(lists):
        part = one.select("qid", "id", F.lit(i).alias("list"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("qid", "id", "list").agg(F.min("rank").alias("rank"))
    places = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    return first.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), *places)


def fused_stories(fusion: DataFrame, owners: DataFrame, limit: int = 50) -> DataFrame:
    """qid, story_id, score, rank_0, rank_1, id, rank: each story by its best member (ties: first list's order first);
    documents without a story are dropped. owners: id, story_id."""
    places = [c for c in fusion.columns if c.startswith("rank_")]
    best = Window.partitionBy("qid", "story_id").orderBy(F.desc("score"), *[F.asc_nulls_last(c) for c in places], "id")
    members = fusion.join(owners.where(F.col("story_id").isNotNull()).select("id", "story_id"), "id")
    stories = members.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return top(stories, "qid", "score", "story_id", limit)


def search(lexical: DataFrame, dense: DataFrame | None, owners: DataFrame, limit: int = 10) -> DataFrame:
    """Hybrid search; without the dense list the answer is lexical alone and marked degraded."""
    lists = [lexical] if dense is None else [lexical, dense]
    return fused_stories(fused(lists), owners, limit).withColumn("degraded", F.lit(dense is None))


def rerank_features(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The 20 features of each (query, story), as columns in the fixed order.

    queries: qid, text, entities (array); candidates: qid, story_id, rrf, lexical_rank, dense_rank, lex_score, dense_sim,
    title, entities, source_count, article_count, max_authority, hn_points_max, hours_since_published, words_max, feed_share.
    """
    parsed = tx.parsed_query(F.col("text"))
    q = queries.select("qid", parsed.alias("p"), F.col("entities").alias("q_ents"))
    rows = candidates.join(q, "qid")
    folded = lambda a: F.array_distinct(F.transform(a, tx.fold_plural))
    q_tokens, title = folded(F.col("p.tokens")), folded(tx.content_tokens(F.col("title")))
    share = lambda a, b: F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    inverse = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    fresh = F.pow(F.lit(0.5), F.col("hours_since_published") / 168.0)
    values: dict[str, Column] = {
        "rrf": F.col("rrf"),
        "lex_rr": inverse("lexical_rank"),
        "dense_rr": inverse("dense_rank"),
        "lex_score": F.coalesce("lex_score", F.lit(0.0)),
        "dense_sim": F.coalesce("dense_sim", F.lit(0.0)),
        "title_cover": share(q_tokens, title),
        "title_phrase": flag((F.col("p.text") != "") & F.contains(tx.collapse(tx.normalize(F.col("title"))), F.col("p.text"))),
        "entity_cover": share(F.array_distinct("q_ents"), F.col("entities")),
        "q_entities": F.size(F.array_distinct("q_ents")).cast("double"),
        "version_match": flag(F.arrays_overlap(F.col("p.versions"), tx.version_tokens(F.col("title")))),
        "q_version": flag(F.size("p.versions") > 0),
        "q_tokens": F.size("p.tokens").cast("double"),
        "log_sources": F.log1p("source_count"),
        "log_articles": F.log1p("article_count"),
        "max_authority": F.col("max_authority"),
        "log_hn_points": F.log1p("hn_points_max"),
        "freshness_7d": fresh,
        "recency_x_fresh": F.when(F.col("p.recency"), fresh).otherwise(0.0),
        "log_words": F.log1p("words_max"),
        "feed_share": F.col("feed_share"),
    }
    return rows.select("qid", "story_id", *[values[n].alias(n) for n in fixed.RERANK_FEATURES])


def tree_score(trees: list[dict], features: list[str]) -> Column:
    """A tree ensemble as one expression. A node is {feature, threshold, left, right, missing: left|right} or {value};
    rows go left where the feature is at most the threshold; a null or NaN goes the missing way, left by default."""

    def walk(node: dict) -> Column:
        if "value" in node:
            return F.lit(float(node["value"]))
        x = F.col(features[node["feature"]])
        absent = x.isNull() | F.isnan(x)
        left = absent if node.get("missing", "left") == "left" else F.lit(False)
        return F.when(left | (~absent & (x <= node["threshold"])), walk(node["left"])).otherwise(walk(node["right"]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + walk(tree)
    return total


def reranked(candidates: DataFrame, model: Column) -> DataFrame:
    """Candidates by model score, then fusion score, then story."""
    w = Window.partitionBy("qid").orderBy(F.desc("model_score"), F.desc("rrf"), "story_id")
    return candidates.withColumn("model_score", F.round(model, 9)).withColumn("rank", F.row_number().over(w))


def topic_relevance(fusion: DataFrame, owners: DataFrame) -> DataFrame:
    """qid, problem_id, relevance: the best member's fused score against the largest of the query."""
    best = fusion.join(owners.where(F.col("problem_id").isNotNull()).select("id", "problem_id"), "id").groupBy("qid", "problem_id").agg(F.max("score").alias("score"))
    largest = best.groupBy("qid").agg(F.max("score").alias("largest"))
    return best.join(largest, "qid").select("qid", "problem_id", F.round(F.col("score") / F.col("largest"), 6).alias("relevance"))


def judging_pool(lists: list[tuple[DataFrame, int]]) -> DataFrame:
    """The distinct (qid, id) of the first places of several lists."""
    out = None
    for one, depth in lists:
        part = one.where(F.col("rank") <= depth).select("qid", "id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def hashed_embedding(c: Column, size: int = 384) -> Column:
    """A unit bag-of-words vector by signed hashing: what stands in where no embedding model is at hand."""
    from storyloom.functions.vectors import unit

    h = F.transform(tx.tokens(c), lambda t: F.xxhash64(t))
    at = F.transform(h, lambda x: F.struct(F.pmod(x, F.lit(size)).alias("i"), F.when(F.pmod(F.shiftright(x, 40), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    zero = F.array_repeat(F.lit(0.0), size)
    added = F.aggregate(at, zero, lambda v, p: F.transform(v, lambda x, i: F.when(i == p["i"], x + p["s"]).otherwise(x)))
    return unit(added)


#: Components of the owners of a block, 8 MB.
OWNER_COMPONENTS = 1 << 20


class OwnerBlock:
    """A block of owners as matrices, in order of the owners."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by("owner").combine_chunks()
        self.owner, self.since = rows["owner"].to_numpy(), rows["since"].to_numpy()
        self.x, self.size = padded(rows["ov"])
        self.norm = np.sqrt(dots(self.x, self.x))

    def best(self, ids: pa.Array, at: np.ndarray | None, x: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """id, owner, similarity of each item's nearest owners of the block: among them the smallest owner of the largest
        similarity after rounding to six places. A matrix product finds them, with errors far below MARGIN; what is
        returned is summed in order of the components, as SQL expressions do. at: None takes all owners for all times."""
        step, width = max(1, TILE // max(1, len(self.owner))), max(x.shape[1], self.x.shape[1])
        mine = np.pad(self.x, ((0, 0), (0, width - self.x.shape[1])))
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        for a in range(0, len(ids), step):
            z = min(len(ids), a + step)
            n = np.sqrt(dots(x[a:z], x[a:z]))
            with np.errstate(all="ignore"):
                length = n[:, None] * self.norm
                s = x[a:z] @ mine.T / length
            s[length == 0] = 0.0
            missing = (size[a:z, None] < 0) | (self.size < 0) | ((size[a:z, None] != self.size) & (length != 0))
            s[missing] = -np.inf
            late = np.zeros(s.shape, bool) if at is None else self.since > at[a:z, None]
            s[late] = -np.inf
            top = s.max(1)
            one = np.isnan(top)  # NaN is the largest of all
            found = [(np.flatnonzero(one), s[one].argmax(1))]
            one = (top == -np.inf) & ~late.all(1)  # owners, but no similarity with any
            found.append((np.flatnonzero(one), late[one].argmin(1)))
            r, c = np.nonzero(s >= np.where(np.isfinite(top), top - 2 / PLACES, np.inf)[:, None])
            u = s[r, c] * PLACES
            open_ = np.abs(u - np.floor(u) - 0.5) < MARGIN  # may be rounded up or down
            sure, first = np.flatnonzero(~open_)[::-1], np.full((z - a, 4), -1)
            below = np.rint(np.where(np.isfinite(top), top, 0.0) * PLACES)[r[sure]] - np.rint(u[sure])
            first[r[sure], below.astype(np.int64)] = sure  # the last one written, of the smallest owner, stays
            first = first[first >= 0]
            found.append((r[first], c[first]))
            r, c = r[open_], c[open_]
            exact = dots(x[a:z][r], mine[c]) / (n[r] * self.norm[c])
            _, first = np.unique(np.stack([r, exact]), axis=1, return_index=True)
            found.append((r[first], c[first]))
            r, c = (np.concatenate(k) for k in zip(*found))
            with np.errstate(all="ignore"):
                exact = np.where(length[r, c] == 0, 0.0, dots(x[a:z][r], mine[c]) / length[r, c])
            columns = [ids.take(pa.array(a + r)), pa.array(self.owner[c]), pa.array(exact, mask=missing[r, c])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "owner", "similarity"])


def nearest_owner(items: DataFrame, owners: DataFrame, timed: bool = False) -> DataFrame:
    """Per item the owner of the largest cosine (ties: smaller owner); timed: among owners whose `since` is at most the
    item's `at` (both integers; null is never met).

    items: id, v; owners: owner, ov. All pairs are scored, as matrix products in Arrow tasks of about TASK_PAIRS each: the
    owners, the stated set, in blocks of OWNER_COMPONENTS components at most, each sent to the tasks once, and a task
    keeps a row or two an item and block. A cosine with a zero vector is 0; with a null one, one with null
    components or one of another length it is null, which is less than any other; NaN is more.
    """
    spark = items.sparkSession
    at, since = (F.col(c).cast("long") if timed else F.lit(0).cast("long") for c in ("at", "since"))
    asked = cut(items.select(F.col("id").cast("long").alias("id"), at.alias("at"), F.col("v").cast("array<double>").alias("v")).where("at is not null"), "items")
    stated = owners.select(F.col("owner").cast("long").alias("owner"), since.alias("since"), F.col("ov").cast("array<double>").alias("ov"))
    stated = cut(stated.where("owner is not null and since is not null").distinct(), "owners")
    n = asked.count()
    size = stated.agg(F.count("*").alias("n"), F.max(F.size("ov")).alias("d")).first()
    blocks = max(1, -(-size["n"] * max(1, size["d"] or 1) * 5 // (4 * OWNER_COMPONENTS)))
    schema, best = "id long, owner long, similarity double", None
    dealt = asked.repartition(max(1, -(-n * size["n"] // (blocks * TASK_PAIRS))))
    for i in range(blocks):
        rows = stated.where(F.pmod(F.xxhash64("owner", "since", "ov"), F.lit(blocks)) == i).toArrow()
        if not rows.num_rows:
            continue

        def meet(batches: Iterator[pa.RecordBatch], block: OwnerBlock = OwnerBlock(rows)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at = batch.column(1).to_numpy() if timed else None
                    yield from block.best(batch.column(0), at, *padded(batch.column(2)))

        part = dealt.mapInArrow(meet, schema)
        best = part if best is None else best.unionByName(part)
    if best is None:
        return spark.createDataFrame([], schema)
    best = best.withColumn("similarity", F.round("similarity", 6))
    top_one = F.max_by(F.struct("owner", "similarity"), F.struct(F.col("similarity"), -F.col("owner")))
    return best.groupBy("id").agg(top_one.alias("x")).select("id", "x.*")


def zero_shot(items: DataFrame, labels: DataFrame) -> DataFrame:
    """id, owner (the label), similarity: the label whose description lies nearest."""
    return nearest_owner(items, labels)


def signals(hits: DataFrame, features: DataFrame, summaries: DataFrame, lexical: DataFrame, dense: DataFrame, owners: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """What rerank_features() needs for each hit: features, lead title, best member scores, entity union. Stories
    without visible articles have no features and drop out."""
    best = lambda rows, c, name: rows.join(owners, "id").groupBy("qid", "story_id").agg(F.max(c).alias(name))
    out = hits.select("qid", "story_id", F.col("score").alias("rrf"), F.col("rank_0").alias("lexical_rank"), F.col("rank_1").alias("dense_rank"))
    out = out.join(features, "story_id").join(summaries.select("story_id", "title"), "story_id")
    out = out.join(best(lexical, "score", "lex_score"), ["qid", "story_id"], "left").join(best(dense, "similarity", "dense_sim"), ["qid", "story_id"], "left")
    if entities is None:
        return out.withColumn("entities", F.array().cast("array<string>"))
    union = entities.join(owners, "id").groupBy("story_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("entities")))).alias("entities"))
    return out.join(union, "story_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
