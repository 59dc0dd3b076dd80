"""The engine's queries over the driver's tables: each takes (spark, sf_dir) and returns a DataFrame.

Times leave as epoch seconds or text, so that results don't depend on a session's time zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom import fixed, schemas
from storyloom.checkpoints import cut, scratch
from storyloom.functions import hashing, urls
from storyloom.functions import text as tx
from storyloom.functions.vectors import centroids, unit
from storyloom.operators import dedup, evaluation, ingest, problems, ranking, retrieval, views
from storyloom.schemas import table

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}


def query(f: Query) -> Query:
    ALL[f.__name__] = f
    return f


def sec(c: str) -> F.Column:
    return F.unix_timestamp(c)


def r6(c: str | F.Column, alias: str | None = None) -> F.Column:
    return F.round(c, 6).alias(alias or c)


def joined(c: str | F.Column) -> F.Column:
    return F.array_join(c, "|")


# ---- text, URLs, keys


@query
def tokens_shingles(spark: SparkSession, sf: str) -> DataFrame:
    t = schemas.articles(spark, sf).select("id", tx.tokens(F.col("body")).alias("t"))
    t = t.select("id", F.size("t").alias("n_tokens"), tx.without(F.col("t"), fixed.STOPWORDS).alias("c"))
    t = t.select("id", "n_tokens", F.size("c").alias("n_content"), tx.shingles(F.col("c")).alias("s"))
    return t.select("id", "n_tokens", "n_content", F.size("s").alias("n_shingles"), F.md5(joined(F.array_sort("s"))).alias("digest"))


@query
def version_tokens(spark: SparkSession, sf: str) -> DataFrame:
    a = schemas.articles(spark, sf)
    return a.select("id", joined(tx.version_tokens(F.col("body"))).alias("versions"), joined(tx.problem_version_tokens(F.col("title"))).alias("named"))


@query
def headline_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.articles(spark, sf).select("id", joined(tx.headline_tokens(F.col("title"))).alias("tokens"))


@query
def cue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.discussions(spark, sf).select("id", *[tx.cue_count(F.col("body"), g).alias(g) for g in fixed.CUES])


@query
def rule_label(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.discussions(spark, sf).select("id", tx.rule_label(F.col("body")).alias("label"))


@query
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.articles(spark, sf).select("id", tx.excerpt(F.col("body"), 280).alias("excerpt"))


@query
def language(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.detect_language(F.coalesce("text", F.lit("")), F.col("lang")).alias("detected"))


@query
def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical_url"), urls.registrable(F.col("url")).alias("site"))
    return p.select("page_id", "canonical_url", urls.url_id(F.col("canonical_url")).alias("article_id"), "site")


@query
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", ingest.page_document(F.col("html")).alias("d"))
    return p.select("page_id", F.col("d.title").alias("title"), F.col("d.word_count").alias("word_count"), F.col("d.content_hash").alias("content_hash"))


@query
def author_hashes(spark: SparkSession, sf: str) -> DataFrame:
    d = schemas.discussions(spark, sf)
    return d.select("id", hashing.author_hash("salt", F.col("platform"), F.col("author_hash")).alias("author"), hashing.idempotency_key(F.lit("extracted"), F.col("id").cast("string"), F.sha2("body", 256)).alias("key"))


# ---- ingestion


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return e.withColumn("k", F.get_json_object("props", "$.k"))


@query
def idempotency_dedup(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    key = hashing.idempotency_key(F.col("event_type"), F.col("user_id").cast("string"), F.coalesce("k", F.lit("")))
    return ingest.claimed(e.select(key.alias("key"), "event_id", "user_id", "event_type"), "key", ["event_id"])


@query
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("user_id", "event_id", F.col("event_id").alias("first_event"), "event_type", "value")
    out = ingest.upserted(e, "user_id", ["event_id"], ["first_event"])
    return out.select("user_id", "first_event", F.col("event_id").alias("last_event"), "event_type", r6("value"))


@query
def envelope_errors(spark: SparkSession, sf: str) -> DataFrame:
    a = schemas.articles(spark, sf)
    rules = {
        "title": F.length("title").between(1, 500), "lede": F.length("lede") <= 1000, "lang": F.col("lang").rlike("^[a-z]{2,3}$"),
        "published_at": F.col("published_at").isNotNull(), "word_count": F.col("word_count") >= 20,
    }
    return ingest.checked(a, rules).where(F.size("errors") > 0).select("id", joined("errors").alias("errors"))


@query
def registry_sync(spark: SparkSession, sf: str) -> DataFrame:
    s = schemas.source_table(spark, sf).select(F.col("source_id").alias("id"), "authority_prior", "category", "enabled")
    n = F.regexp_extract("id", r"(\d+)$", 1).try_cast("int")
    new = s.where(n % 5 != 0).withColumn("category", F.upper("category")).unionByName(s.where(n % 7 == 0).withColumn("id", F.concat("id", F.lit("-new"))))
    return ingest.synced_registry(s, new).select("id", r6("authority_prior"), "category", "enabled")


@query
def registry_problems(spark: SparkSession, sf: str) -> DataFrame:
    s = schemas.source_table(spark, sf)
    n = F.regexp_extract("source_id", r"(\d+)$", 1).try_cast("int")
    bad = s.select(
        F.when(n % 6 == 0, F.upper("source_id")).otherwise(F.col("source_id")).alias("id"), F.when(n % 4 == 0, "mail").otherwise("rss").alias("kind"),
        F.concat(F.when(n % 5 == 0, "http://").otherwise("https://"), "source_id").alias("url"), (F.col("authority_prior") + F.when(n % 7 == 0, 0.9).otherwise(0.0)).alias("authority_prior"),
    )
    return ingest.registry_errors(bad).select("id", joined("errors").alias("errors"))


@query
def mature_items(spark: SparkSession, sf: str) -> DataFrame:
    d = schemas.discussions(spark, sf)
    now = d.agg(F.max("observed_at")).first()[0]
    return d.where("turn = 0").where(ingest.mature(F.col("observed_at"), F.lit(now), 2, 48)).select("id", "platform")


@query
def thread_comments_top(spark: SparkSession, sf: str) -> DataFrame:
    """Turn t answers turn (t - 1) div 2, which makes a tree of each conversation."""
    d = schemas.discussions(spark, sf)
    parent = F.when(F.col("turn") > 0, F.col("thread_id") * 100 + F.floor((F.col("turn") - 1) / 2))
    rows = d.select("thread_id", "id", parent.alias("parent_id"), "points")
    return ingest.thread_comments(rows, 10).select("thread_id", "id", "replies", "place")


# ---- duplicates and clusters


@query
def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.content_duplicates(schemas.articles(spark, sf))


def _signed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    a = schemas.articles(spark, sf)
    return a, cut(dedup.signatures(a), "signatures")


@query
def minhash_bands(spark: SparkSession, sf: str) -> DataFrame:
    s = dedup.signatures(schemas.articles(spark, sf))
    return s.select("id", F.md5(F.array_join(F.transform("signature", lambda x: x.cast("string")), ",")).alias("signature"), F.md5(joined("bands")).alias("bands"))


@query
def lsh_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _signed(spark, sf)
    return dedup.lsh_pairs(s, a).select("a", "b", r6("jaccard"))


@query
def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _signed(spark, sf)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    p = dedup.pair_scores(dedup.lsh_pairs(s, a), a, v)
    return p.select("a", "b", r6("max_member_cosine"), r6("title_jaccard"), r6("hours_gap"), "same_source", r6("probability"), "joins")


@query
def story_components(spark: SparkSession, sf: str) -> DataFrame:
    a, s = _signed(spark, sf)
    return dedup.story_components(a, dedup.lsh_pairs(s, a).where("jaccard >= 0.5"))


@query
def story_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Order-dependent, so one task by its meaning; the scalable form is story_components."""
    a, s = _signed(spark, sf)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = a.join(s, "id", "left").join(v, "id", "left")
    t = F.array_distinct(tx.content_tokens(F.col("title")))
    return dedup.replay(rows.select("id", "discovered_at", "source_id", "content_hash", t.alias("t"), tx.version_tokens(F.col("title")).alias("ver"), "bands", "signature", "v"))


@query
def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("at", "x")).select("label", "at", r6("x"))


# ---- stories and the feed


def _as_of(spark: SparkSession, sf: str) -> F.Column:
    return schemas.as_of(spark, sf)


def _stories(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, F.Column]:
    return schemas.articles_with_stories(spark, sf).drop("body", "lede"), schemas.source_table(spark, sf), _as_of(spark, sf)


@query
def story_summary(spark: SparkSession, sf: str) -> DataFrame:
    a, s, _ = _stories(spark, sf)
    out = ranking.story_summary(a, s)
    return out.select("story_id", "article_count", "source_count", "representative_id", "title", "lead_source", joined("sources").alias("sources"), sec("first_seen_at").alias("first_seen"), sec("published_at").alias("published"))


@query
def story_features(spark: SparkSession, sf: str) -> DataFrame:
    a, s, now = _stories(spark, sf)
    f = ranking.story_features(a, s, now)
    return f.select("story_id", "article_count", "source_count", r6("max_authority"), r6("mean_authority"), "hn_points_max", "hn_comments_max", r6("feed_share"), "words_max", r6("hours_since_published"), r6("hours_since_first_seen"), r6("velocity_per_hour"))


@query
def feed_scores(spark: SparkSession, sf: str) -> DataFrame:
    a, s, now = _stories(spark, sf)
    f = ranking.heuristic(ranking.story_features(a, s, now))
    return f.select("story_id", r6("coverage"), r6("authority"), r6("community"), r6("freshness"), r6("score"))


@query
def recent_pool(spark: SparkSession, sf: str) -> DataFrame:
    a, _, now = _stories(spark, sf)
    return ranking.recent_pool(a, now - F.make_dt_interval(hours=F.lit(72))).select("story_id", sec("latest").alias("latest"))


@query
def feed_top(spark: SparkSession, sf: str) -> DataFrame:
    a, s, now = _stories(spark, sf)
    return ranking.feed(a, s, now, limit=50).select("rank", "story_id", r6("score"), "lead_source", "title")


@query
def feed_diversified(spark: SparkSession, sf: str) -> DataFrame:
    a, s, now = _stories(spark, sf)
    out = ranking.diversified(ranking.feed(a, s, now).select("rank", "story_id", "score", "lead_source"))
    return out.select("position", "rank", "story_id", "lead_source", r6("score"))


@query
def rank_delta(spark: SparkSession, sf: str) -> DataFrame:
    a, s, now = _stories(spark, sf)
    f = ranking.story_features(a, s, now)
    place = lambda x: x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "story_id")))
    pool = ranking.recent_pool(a, now - F.make_dt_interval(hours=F.lit(72))).select("story_id")
    f = f.join(F.broadcast(pool), "story_id")
    return ranking.rank_change(place(ranking.heuristic(f)), place(ranking.heuristic(f, sources=2.0, half_life=48.0)))


@query
def source_share(spark: SparkSession, sf: str) -> DataFrame:
    a, s, now = _stories(spark, sf)
    return ranking.source_share(ranking.feed(a, s, now)).select("lead_sources", "top_source", r6("top_share"))


@query
def race_to_report(spark: SparkSession, sf: str) -> DataFrame:
    a, _, _ = _stories(spark, sf)
    return ranking.race(a).select("story_id", "id", "source_id", "place", r6("minutes_behind"))


@query
def briefing(spark: SparkSession, sf: str) -> DataFrame:
    a, _, _ = _stories(spark, sf)
    return ranking.first_reports(a).select("story_id", "first_source", "others", r6("span_hours"))


@query
def newest_members(spark: SparkSession, sf: str) -> DataFrame:
    a, _, _ = _stories(spark, sf)
    return ranking.newest_members(a).select("story_id", "id", "place")


@query
def story_problem_links(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest problem of each article with a vector, among those last seen before it; a problem's vector is that of its id."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    a = schemas.articles(spark, sf).select("id", F.unix_micros("discovered_at").alias("at")).join(v, "id")
    p = _problems(spark, sf)[1].select(F.col("problem_id").alias("owner"), F.unix_micros("last_seen_at").alias("since")).join(v.toDF("owner", "ov"), "owner")
    return retrieval.nearest_owner(a, p, timed=True)


@query
def zero_shot_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of ids 0 to 5 stand in for six label descriptions."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.zero_shot(v, v.where("id < 6").toDF("owner", "ov"))


@query
def pair_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs sampled by similarity bin and same source, five of each."""
    a, s = _signed(spark, sf)
    src = a.select("id", "source_id")
    pairs = dedup.lsh_pairs(s, a).join(src.toDF("a", "sa"), "a").join(src.toDF("b", "sb"), "b")
    stratum = F.concat_ws("|", F.floor(F.col("jaccard") * 10).cast("string"), (F.col("sa") == F.col("sb")).cast("int").cast("string"))
    rows = pairs.select("a", "b", stratum.alias("stratum"), F.concat_ws("-", "a", "b").alias("pair"))
    return evaluation.stratified_sample(rows, "stratum", "pair", 5).select("stratum", "a", "b", "place")


@query
def primary_stories(spark: SparkSession, sf: str) -> DataFrame:
    a, s, _ = _stories(spark, sf)
    return ranking.primary_only(a, s)


@query
def adaptive_window(spark: SparkSession, sf: str) -> DataFrame:
    a, _, now = _stories(spark, sf)
    return ranking.adaptive_window(a, now).select("story_id", r6("age"), "window_hours")


@query
def feed_rows(spark: SparkSession, sf: str) -> DataFrame:
    a, s, _ = _stories(spark, sf)
    return ranking.feed_items(ranking.story_summary(a, s))


@query
def feed_interleaved(spark: SparkSession, sf: str) -> DataFrame:
    a, s, now = _stories(spark, sf)
    stories = ranking.feed(a, s, now).select("rank", F.col("story_id").alias("id"))
    return ranking.interleaved(stories, _listed(spark, sf).select("rank", F.col("problem_id").alias("id")))


# ---- search


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a = schemas.articles(spark, sf).select("id", "title", "body")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))
    terms = cut(retrieval.tokenized(a), "terms")
    return retrieval.postings(terms, queries), retrieval.corpus_size(terms), queries


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(*_index(spark, sf))


def _dense(spark: SparkSession, sf: str, depth: int = 20) -> DataFrame:
    """The stated queries are the vectors whose id is divisible by 100; query q's vector is that of id 100 q."""
    v = table(spark, sf, "embeddings")
    return retrieval.nearest(v, v.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), depth)


@query
def bm25_top(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf).select("qid", "id", "rank", "score", "matched")


@query
def and_match(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that have all of a benchmark text's content tokens."""
    return retrieval.match_all(retrieval.bm25(*_index(spark, sf), depth=None)).select("qid", "id", "rank", "score")


@query
def knn_top(spark: SparkSession, sf: str) -> DataFrame:
    return _dense(spark, sf).select("qid", "id", "rank", "similarity")


def _fused(spark: SparkSession, sf: str, depth: int = 20) -> DataFrame:
    dense = _dense(spark, sf, depth).withColumn("qid", F.expr("qid div 100"))
    return retrieval.fused([_lexical(spark, sf), dense])


@query
def rrf_fused(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("qid", "id", "score", "rank_0", "rank_1")


@query
def stories_fused(spark: SparkSession, sf: str) -> DataFrame:
    owners = schemas.articles_with_stories(spark, sf).select("id", "story_id")
    return retrieval.fused_stories(_fused(spark, sf), owners).select("qid", "story_id", "id", "score", "rank")


@query
def rerank_features(spark: SparkSession, sf: str) -> DataFrame:
    a, s, now = _stories(spark, sf)
    a = cut(a, "articles")
    lexical, dense = cut(_lexical(spark, sf), "lexical"), cut(_dense(spark, sf, retrieval.DEPTH).withColumn("qid", F.expr("qid div 100")), "dense")
    hits = cut(retrieval.fused_stories(retrieval.fused([lexical, dense]), a.select("id", "story_id")), "hits")
    signals = retrieval.signals(hits, ranking.story_features(a, s, now), ranking.story_summary(a, s), lexical, dense, a.select("id", "story_id"))
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<string>").alias("entities"))
    out = retrieval.rerank_features(queries, signals)
    return out.select("qid", "story_id", *[r6(F.col(c), c) for c in fixed.RERANK_FEATURES])


def _qrels(pool: DataFrame) -> DataFrame:
    return pool.select("qid", "id", ((F.col("id") + F.col("qid")) % 4).cast("int").alias("grade"))


@query
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    lexical = cut(_lexical(spark, sf), "lexical")
    pool = retrieval.judging_pool([(lexical, 50)])
    m = evaluation.ranking_metrics(lexical, _qrels(pool))
    return m.select("qid", r6("ndcg"), r6("recall"), r6("mrr"))


@query
def judging_pool(spark: SparkSession, sf: str) -> DataFrame:
    dense = _dense(spark, sf).withColumn("qid", F.expr("qid div 100"))
    return retrieval.judging_pool([(_lexical(spark, sf), 50), (dense, 20)])


# ---- problems


def _problems(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, F.Column]:
    d = schemas.discussions(spark, sf)
    p = cut(problems.summary(d), "problems")
    return d, p, F.lit(d.agg(F.max("observed_at")).first()[0])


@query
def problem_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = problems.summary(schemas.discussions(spark, sf))
    return p.select("problem_id", "member_count", "voice_count", r6("effective_voices"), "source_count", "platform_count", "engagement", "category", "representative_id", "statement", sec("first_seen_at").alias("first_seen"), sec("last_seen_at").alias("last_seen"))


@query
def demand_score(spark: SparkSession, sf: str) -> DataFrame:
    _, p, now = _problems(spark, sf)
    return problems.demand(p, now).select("problem_id", r6("f_voices"), r6("f_sources"), r6("f_recency"), r6("f_engagement"), r6("f_category"), r6("demand"))


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    _, p, now = _problems(spark, sf)
    return problems.listing(p, now, min_voices=2)


@query
def problem_detail(spark: SparkSession, sf: str) -> DataFrame:
    _, p, now = _problems(spark, sf)
    return problems.detail(p, 1, now)


@query
def statement_echo(spark: SparkSession, sf: str) -> DataFrame:
    d, p, _ = _problems(spark, sf)
    e = problems.evidence(d).join(p.select("problem_id", "statement"), "problem_id")
    return e.select("problem_id", "id", tx.echoes(tx.excerpt(F.col("body")), F.col("statement")).alias("echo"))


@query
def problem_list(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(spark, sf).select("rank", "problem_id", "category", "final")


@query
def topic_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Every problem's relevance to each benchmark text over its member documents."""
    d = schemas.discussions(spark, sf)
    docs = d.where("problem_id is not null").select("id", F.left("body", F.lit(160)).alias("title"), "body")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))
    terms = cut(retrieval.tokenized(docs), "terms")
    lexical = retrieval.bm25(cut(retrieval.postings(terms), "postings"), retrieval.corpus_size(terms), queries)
    return retrieval.topic_relevance(retrieval.fused([lexical]), d.select("id", "problem_id"))


@query
def evidence_top(spark: SparkSession, sf: str) -> DataFrame:
    return problems.evidence(schemas.discussions(spark, sf)).select("problem_id", "id", "rn", "eng", r6("p_problem"))


@query
def join_positions(spark: SparkSession, sf: str) -> DataFrame:
    return problems.join_positions(schemas.discussions(spark, sf))


@query
def entity_top(spark: SparkSession, sf: str) -> DataFrame:
    """Content tokens stand in for entities, of which these tables name none."""
    d = schemas.discussions(spark, sf)
    return problems.top_terms(d, tx.content_tokens(F.col("body"))).select("problem_id", "term", "n", "place")


@query
def problem_platforms(spark: SparkSession, sf: str) -> DataFrame:
    return problems.platforms(schemas.discussions(spark, sf)).select("problem_id", joined("platforms").alias("platforms"))


@query
def admission(spark: SparkSession, sf: str) -> DataFrame:
    return problems.admission(schemas.discussions(spark, sf)).select("source_id", "docs", "admitted", r6("share"))


# ---- views and evaluation


@query
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    a, s, _ = _stories(spark, sf)
    d, p, now = _problems(spark, sf)
    return views.corpus_stats(a, d, p, s, now).withColumn("last_discovered_at", sec("last_discovered_at"))


@query
def pulse_hourly(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return views.pulse(e, "ts", "event_type", now, 48).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "kind", "n")


@query
def island_labels(spark: SparkSession, sf: str) -> DataFrame:
    a = schemas.articles(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("island")), "id")
    return views.island_labels(a.select("id", "title", "island"))


@query
def semantic_map(spark: SparkSession, sf: str) -> DataFrame:
    """The newest articles with a vector, placed in two dimensions."""
    a = schemas.articles(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    return views.semantic_map(a.select("id", "v", F.col("word_count").alias("weight"), F.col("discovered_at").alias("seen_at")))


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic scores against the labels: arithmetic checks, no quality claim."""
    score = ((F.col("doc_id") * 37 + F.col("quality") * 29) % 101) / F.lit(100.0)
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("gold"), score.alias("score"), (F.col("doc_id") % 5).alias("stratum"))


@query
def wilson_floors(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.precision_at_floors(_graded(spark, sf), [0.5, 0.7, 0.74, 0.77, 0.8])
    return out.select("floor", "n", "k", r6("precision"), r6("low"), r6("high"))


@query
def threshold_select(spark: SparkSession, sf: str) -> DataFrame:
    curve = evaluation.threshold_curve(_graded(spark, sf))
    a = evaluation.chosen_threshold(curve).withColumn("rule", F.lit("f1"))
    b = evaluation.chosen_threshold(curve, 0.9).withColumn("rule", F.lit("precision"))
    return a.unionByName(b).select("rule", r6("threshold"), "tp", "selected", r6("precision"), r6("recall"), r6("f1"))


@query
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.stratified_sample(_graded(spark, sf), "stratum", "doc_id", 10).select("stratum", "doc_id", "place")


@query
def weighted_prf(spark: SparkSession, sf: str) -> DataFrame:
    g = _graded(spark, sf)
    population = table(spark, sf, "documents").groupBy((F.col("doc_id") % 5).alias("stratum")).agg(F.count("*").alias("population"))
    rows = evaluation.design_weights(g.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "stratum", population)
    return evaluation.prf(rows, "weight").select(r6("precision"), r6("recall"), r6("f1"))


@query
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d = schemas.discussions(spark, sf)
    guess = F.element_at(F.array(*[F.lit(x) for x in fixed.LABELS[:4]]), (F.col("id") % 4 + 1).cast("int"))
    return evaluation.per_class(d.select(F.col("category").alias("gold"), guess.alias("predicted"))).select("label", r6("precision"), r6("recall"), r6("f1"))


@query
def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and interval of the benchmark texts' lengths over 200 hashed replicates."""
    b = table(spark, sf, "benchmark").select((F.row_number().over(Window.orderBy("item_id")) - 1).cast("bigint").alias("i"), F.length("text").cast("double").alias("value"))
    return evaluation.bootstrap_interval(b, 200).select(r6("mean"), r6("low"), r6("high"))


@query
def judgment_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Judgments written as text lines from the labels, and parsed again."""
    l = table(spark, sf, "labels")
    item = F.concat(F.when(F.col("doc_id") % 2 == 0, "+").otherwise(""), F.col("doc_id").cast("string"), F.lit("="), (F.col("quality") * 2 + F.col("toxic")).cast("string"))
    lines = l.groupBy((F.col("doc_id") % 20).alias("q")).agg(F.concat(F.lit("q"), F.col("q").cast("string"), F.lit(": "), F.array_join(F.array_sort(F.collect_list(item)), " ")).alias("value"))
    return evaluation.judgments(lines.select("value"))


@query
def matrix_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.fingerprint(_graded(spark, sf), ["doc_id"], ["score"])
    return out.select("n", F.col("digest").cast("string").alias("digest"))


@query
def merge_precision(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 2).alias("audit"), (F.col("doc_id") % 3).alias("policy"), F.col("quality").alias("correct"))
    return evaluation.merge_precision(rows).select("audit", "policy", "n", "k", r6("precision"), r6("low"), r6("high"))


# ---- functions and models that the queries above leave out


@query
def folded_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.articles(spark, sf).select("id", joined(F.transform(tx.content_tokens(F.col("title")), tx.fold_plural)).alias("tokens"))


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", tx.strip_tags(F.coalesce("html", F.lit(""))).alias("t"))
    return p.select("page_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query
def opening_texts(spark: SparkSession, sf: str) -> DataFrame:
    a = schemas.articles(spark, sf).select("id", tx.opening_text(F.left("title", F.lit(60)), F.left("body", F.lit(1000))).alias("t"))
    return a.select("id", F.md5("t").alias("digest"), tx.long_enough(F.col("t")).alias("long_enough"))


@query
def cards(spark: SparkSession, sf: str) -> DataFrame:
    a = schemas.articles(spark, sf)
    return a.select("id", tx.relative_time(_as_of(spark, sf), F.col("discovered_at")).alias("age"), tx.initials(F.concat(F.lit("News "), F.col("source_id"))).alias("initials"))


@query
def query_parse(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), tx.parsed_query(F.concat(F.lit("Latest "), F.coalesce("text", F.lit("")))).alias("p"))
    return q.select("qid", F.col("p.text").alias("text"), joined("p.tokens").alias("tokens"), F.col("p.recency").alias("recency"))


#: Function words stand in for names, of which the invented prose has none: id, aliases, whether case matters.
ENTITIES = [("negation", ["nicht", "nicht ein", "not"], False), ("past", ["was", "that was"], False), ("article-fr", ["une", "des"], False), ("opening-de", ["Der", "Die", "Das"], True)]


@query
def gazetteer_entities(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.articles(spark, sf).select("id", joined(tx.gazetteer(F.col("body"), ENTITIES)).alias("entities"))


@query
def entity_unions(spark: SparkSession, sf: str) -> DataFrame:
    """The entities of each story's articles."""
    a = schemas.articles_with_stories(spark, sf).select("story_id", F.explode_outer(tx.gazetteer(F.col("body"), ENTITIES)).alias("entity"))
    return a.groupBy("story_id").agg(joined(F.array_sort(F.collect_set("entity"))).alias("entities"))


@query
def feed_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """What a page's markup would give as a feed item's content; null where it is too poor."""
    p = table(spark, sf, "pages").select("page_id", ingest.feed_document(F.concat(F.lit("Page "), F.col("page_id").cast("string")), F.coalesce("html", F.lit("")), F.col("url")).alias("d"))
    return p.select("page_id", F.col("d.title").alias("title"), F.md5("d.text").alias("text"), F.md5("d.lede").alias("lede"), F.col("d.content_origin").alias("origin"))


@query
def doc_kinds(spark: SparkSession, sf: str) -> DataFrame:
    d = schemas.discussions(spark, sf)
    kind = F.when(F.col("turn") % 3 == 1, "article").when(F.col("turn") % 3 == 2, "discussion")
    return d.select("id", ingest.document_kind(kind, F.when(F.col("turn") % 2 == 1, F.col("platform"))).alias("kind"))


#: A small ensemble in the form that tree_score() takes, over the story features named here.
TREE_FEATURES = ["source_count", "max_authority", "hours_since_published"]
TREES = [
    {"feature": 1, "threshold": 0.7, "left": {"value": 0.1}, "right": {"feature": 2, "threshold": 30.0, "left": {"value": 0.9}, "right": {"value": 0.4}}},
    {"feature": 0, "threshold": 1.0, "left": {"value": 0.05}, "right": {"value": 0.5}},
]


@query
def tree_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The feed's best 50 ranked anew by a tree ensemble."""
    a, s, now = _stories(spark, sf)
    c = ranking.feed(a, s, now, limit=50).select(F.lit(1).alias("qid"), "story_id", F.round("score", 6).alias("rrf"), *TREE_FEATURES)
    return retrieval.reranked(c, retrieval.tree_score(TREES, TREE_FEATURES)).select("rank", "story_id", r6("model_score"), "rrf")


@query
def hybrid_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Rank fusion with both lists at their full depth of 200."""
    return _fused(spark, sf, retrieval.DEPTH).select("qid", "id", "score", "rank_0", "rank_1")


@query
def hybrid_stories(spark: SparkSession, sf: str) -> DataFrame:
    """Stories of the full fusion."""
    owners = schemas.articles_with_stories(spark, sf).select("id", "story_id")
    return retrieval.fused_stories(_fused(spark, sf, retrieval.DEPTH), owners).select("qid", "story_id", "id", "score", "rank")


def _headlined(spark: SparkSession, sf: str) -> DataFrame:
    """Discussions with headline, its tokens and versions, and the unit vector of their thread's number. The thread's title is synthetic."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("thread_id"), F.col("embedding").cast("array<double>").alias("e"))
    d = schemas.discussions(spark, sf).join(v, "thread_id", "left")
    d = d.withColumn("headline", problems.headline(F.concat(F.lit("thread "), F.col("thread_id").cast("string")), F.col("body"), F.col("is_comment")))
    return d.withColumns({"t": tx.headline_tokens(F.col("headline")), "ver": tx.problem_version_tokens(F.col("headline")), "v": unit(F.col("e"))})


@query
def headlines(spark: SparkSession, sf: str) -> DataFrame:
    return _headlined(spark, sf).select("id", "headline", joined("t").alias("tokens"))


def _assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One conversation in ten has its problem already; one turn in seventeen has no classification."""
    d = _headlined(spark, sf).withColumn("existing", F.when(F.col("thread_id") % 10 == 0, -F.col("thread_id") - 1)).withColumn("p_problem", F.when(F.col("id") % 17 != 0, F.col("p_problem")))
    return d, problems.assigned(d.drop("problem_id"), "thread_id")


@query
def problem_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return _assigned(spark, sf)[1].select("id", "decision", "problem_id", r6("probability"))


@query
def assigned_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries refreshed from the members that the assignment gives."""
    d, found = _assigned(spark, sf)
    p = problems.summary(d.drop("problem_id").join(found.select("id", "problem_id"), "id"))
    return p.select("problem_id", "member_count", "voice_count", r6("effective_voices"), "engagement", "category", "representative_id")


@query
def problem_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return problems.sizes(problems.summary(schemas.discussions(spark, sf)))


@query
def topic_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Problems relevant to the first benchmark text, by relevance and the root of demand."""
    _, p, now = _problems(spark, sf)
    first = table(spark, sf, "benchmark").agg(F.min("item_id").alias("qid"))
    rel = topic_relevance(spark, sf).join(first, "qid").select("problem_id", "relevance")
    return problems.listing(p, now, relevance=rel).select("rank", "problem_id", r6("relevance"), "final")


#: A six-class model over the six cue counts, from a rule.
CLASS_WEIGHTS = [[((i * 7 + j * 3) % 5 - 2) / 2 for j in range(6)] for i in range(6)]
CLASS_INTERCEPTS = [i / 10 for i in range(6)]


@query
def classified(spark: SparkSession, sf: str) -> DataFrame:
    f = problems.cue_features(F.col("body"))
    p = schemas.discussions(spark, sf).select("id", problems.softmax(f, CLASS_WEIGHTS, CLASS_INTERCEPTS, [0.0] * 6, [1.0] * 6).alias("p"))
    p = p.select("id", problems.decided(F.col("p")).alias("d"))
    return p.select("id", F.round("d.p_problem", 6).alias("p_problem"), F.col("d.is_problem").alias("is_problem"), F.col("d.category").alias("category"))


@query
def json_feed_rows(spark: SparkSession, sf: str) -> DataFrame:
    a, s, _ = _stories(spark, sf)
    return ranking.json_feed_items(ranking.story_summary(a, s).withColumn("sources", joined("sources")))


@query
def problem_feed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.problem_items(problems.summary(schemas.discussions(spark, sf)))


@query
def cross_folds(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.folds(_graded(spark, sf), "doc_id", 5, "stratum").select("doc_id", "stratum", "fold")


@query
def bin_precision(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.precision_by_bin(_graded(spark, sf), [0.0, 0.3, 0.5, 0.7, 0.9, 1.1])
    return out.select("bin", "n", "k", r6("precision"), r6("low"), r6("high"))


@query
def class_overall(spark: SparkSession, sf: str) -> DataFrame:
    d = schemas.discussions(spark, sf)
    guess = F.element_at(F.array(*[F.lit(x) for x in fixed.LABELS[:4]]), (F.col("id") % 4 + 1).cast("int"))
    return evaluation.overall(d.select(F.col("category").alias("gold"), guess.alias("predicted"))).select(r6("accuracy"), r6("macro_f1"), "classes")


@query
def missing_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Strata of the documents by source in which no document is labelled toxic."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    known = d.join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return evaluation.missing(d.where("source is not null and lang is not null"), known, ["source", "lang"])


# ---- streaming


@query
def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of the events read as a stream until its source is empty."""
    import uuid

    from storyloom.streaming.stream import table_stream, written_once

    stream = table_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    where = f"{scratch(spark)}/hourly-{uuid.uuid4().hex}"
    out = written_once(counts.select(F.col("w.start").alias("hour"), "event_type", "n"), f"{where}/table", f"{where}/checkpoint")
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


# ---- general relational forms: native extensions, of which the model system has none


@query
def native_rollup(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    out = l.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().alias("level"))
    return out.select("l_returnflag", "l_linestatus", "n", "quantity", F.col("level").cast("int").alias("level"))


@query
def native_semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    has = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("with_orders"))
    no = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("without_orders"))
    return has.join(no, "c_nationkey", "full_outer").select("c_nationkey", F.coalesce("with_orders", F.lit(0)).alias("with_orders"), F.coalesce("without_orders", F.lit(0)).alias("without_orders"))
