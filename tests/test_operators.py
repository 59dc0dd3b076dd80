"""Operators on small frames, and every query against its SQL."""

import datetime as dt
import json
import math
import os
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom import fixed, schemas
from storyloom.functions.vectors import cosine
from storyloom.operators import dedup, evaluation, ingest, problems, ranking, retrieval, views
from storyloom.plans import oracles, queries

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 1, 10)


def hours(n):
    return NOW - dt.timedelta(hours=n)


ARTICLE = "story_id long, id long, source_id string, discovered_at timestamp, published_at timestamp, hn_points int, hn_comments int, content_origin string, word_count int, title string"


def articles(spark, rows):
    return spark.createDataFrame([(s, i, src, hours(h), hours(h) if p else None, pts, None, "feed", 10, f"t{i}") for s, i, src, h, p, pts in rows], ARTICLE)


def sources(spark):
    return spark.createDataFrame([("a", 0.9, "primary"), ("b", 0.5, "press"), ("c", 0.9, "press")], "source_id string, authority_prior double, category string")


def test_story_features_and_score(spark):
    a = articles(spark, [(1, 1, "a", 18, True, 3), (1, 2, "b", 5, False, None), (2, 3, "b", 0, True, None), (1, 4, "c", -3, True, 99)])
    f = {r.story_id: r for r in ranking.heuristic(ranking.story_features(a, sources(spark), F.lit(NOW))).collect()}
    assert f[1].article_count == 2 and f[1].hn_points_max == 3 and f[1].hours_since_published == 18
    want = (1.2 * math.log1p(2) + 0.9 + 0.35 * math.log1p(3)) * 0.5
    assert math.isclose(f[1].score, want) and math.isclose(f[1].score, (f[1].coverage + f[1].authority + f[1].community) * f[1].freshness)
    assert f[2].hours_since_published == 0 and f[2].velocity_per_hour == 1
    with pytest.raises(ValueError):
        ranking.heuristic(a, half_life=1)


def test_summary_puts_the_lead_first(spark):
    a = articles(spark, [(1, 5, "b", 9, True, 0), (1, 6, "c", 7, True, 0), (1, 7, "a", 7, False, 0)])
    r = ranking.story_summary(a, sources(spark)).first()
    assert (r.representative_id, r.sources, r.source_count) == (6, ["c", "a", "b"], 3)


def diverse(spark, leads, caps=ranking.CAPS):
    rows = [(i, i, lead) for i, lead in enumerate(leads, 1)]
    out = ranking.diversified(spark.createDataFrame(rows, "rank int, story_id long, lead_source string"), caps).orderBy("position").collect()
    return [r.lead_source for r in out], [r["rank"] for r in out]


def test_diversify_caps(spark):
    leads, order = diverse(spark, ["A"] * 30 + list("BCDEFGHIJKLMNOPQRSTUVWXYZ"))
    assert leads[:10].count("A") == 2 and leads[:20].count("A") == 3 and sorted(order) == list(range(1, 56))
    assert diverse(spark, ["A"] * 5)[1] == [1, 2, 3, 4, 5]
    assert diverse(spark, [None, None, None, "B"])[0] == [None, None, "B", None]


def test_diversify_is_a_permutation(spark):
    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.sampled_from("ABCD"), min_size=1, max_size=40))
    def check(leads):
        got, order = diverse(spark, leads)
        assert sorted(order) == list(range(1, len(leads) + 1))
        for x in "ABCD":  # a source's own order stays
            own = [r for r, lead in zip(order, got) if lead == x]
            assert own == sorted(own)

    check()


def test_race_pool_and_window(spark):
    a = articles(spark, [(1, 1, "a", 5, True, 0), (1, 2, "b", 4, True, 0), (2, 3, "a", 1, True, 0), (3, 4, "a", 60, True, 0), (9, 5, "b", 100, True, 0)])
    assert [(r.id, r.place, r.minutes_behind) for r in ranking.race(a).orderBy("place").collect()] == [(1, 1, 0.0), (2, 2, 60.0)]
    assert [r.story_id for r in ranking.recent_pool(a, F.lit(hours(72))).collect()] == [2, 1, 3]
    assert {r.story_id for r in ranking.adaptive_window(a, F.lit(NOW)).collect()} == {1, 2, 3}
    assert {r.story_id for r in ranking.adaptive_window(a, F.lit(NOW), enough=2).collect()} == {1, 2}
    assert {r.story_id for r in ranking.primary_only(a, sources(spark)).collect()} == {1, 2, 3}


def test_interleave(spark):
    s = spark.createDataFrame([(i, 100 + i) for i in range(1, 10)], "rank int, id long")
    p = spark.createDataFrame([(i, 500 + i) for i in range(1, 5)], "rank int, id long")
    got = [r.id for r in ranking.interleaved(s, p).orderBy("place").collect()]
    assert got == [101, 102, 103, 104, 501, 105, 106, 107, 108, 502, 109]


DISCUSSION = "problem_id long, id long, author_hash string, source_id string, platform string, points int, comments int, reactions int, p_problem double, category string, observed_at timestamp, body string, is_comment boolean"


def test_problem_summary(spark):
    rows = [(1, 10, "x", "s", "hn", -5, 2, None, 0.9, "b", hours(3), "first", False), (1, 11, "x", "s", "hn", 4, 0, 1, 0.6, "a", hours(2), "again", True), (1, 12, None, "t", "github", 0, 0, 0, 0.3, "a", hours(1), "other", True), (None, 13, "y", "s", "hn", 0, 0, 0, 0.1, "a", hours(1), "not admitted", False)]
    d = spark.createDataFrame(rows, DISCUSSION)
    r = problems.summary(d).first()
    assert (r.member_count, r.voice_count, r.source_count, r.platform_count, r.engagement) == (3, 2, 2, 2, 7)
    assert math.isclose(r.effective_voices, 1.2) and r.category == "a" and r.representative_id == 10
    assert [x.id for x in problems.evidence(d, 2).orderBy("rn").collect()] == [10, 11]
    assert [(x.id, x.joined, x.creator_id) for x in problems.join_positions(d).orderBy("position").collect()] == [(10, False, 10), (11, True, 10), (12, True, 10)]


def test_demand_is_monotone(spark):
    row = lambda i, v, s, e, age, c: (i, float(v), s, e, hours(24 * age), c, v)
    p = spark.createDataFrame([row(1, 5, 2, 3, 0, "missing_capability"), row(2, 1, 1, 5000, 0, "missing_capability"), row(3, 5, 2, 3, 30, "missing_capability"), row(4, 5, 2, 3, 0, "odd"), row(5, 0, 0, 0, 0, None)], "problem_id long, effective_voices double, source_count int, engagement long, last_seen_at timestamp, category string, voice_count int")
    d = {r.problem_id: r for r in problems.demand(p, F.lit(NOW)).collect()}
    assert d[1].demand > d[2].demand and math.isclose(d[3].demand, d[1].demand / 2) and math.isclose(d[4].demand / d[1].demand, 0.8 / 1.2) and d[5].demand == 0
    assert [r.problem_id for r in problems.listing(p, F.lit(NOW), min_voices=2).orderBy("rank").collect()] == [1, 4, 3]
    rel = spark.createDataFrame([(3, 1.0), (1, 0.5), (4, 0.4)], "problem_id long, relevance double")
    out = problems.listing(p, F.lit(NOW), relevance=rel).orderBy("rank").collect()
    assert [r.problem_id for r in out] == [3, 1] and math.isclose(out[0].final, round(math.sqrt(d[3].demand), 6))


def test_scorers(spark):
    names = ["max_member_cosine", "centroid_cosine", "minhash_jaccard", "title_jaccard", "entity_jaccard", "hours_gap", "same_source", "version_conflict"]
    rows = spark.createDataFrame([(0.95, 0.9, 0.5, 0.4, 0.0, 2.0, 0, 0), (0.95, 0.9, 0.5, 0.4, 0.0, 2.0, 0, 1), (-1.0, 0.0, 0.0, 0.0, 0.0, 2000.0, 1, 1)], ", ".join(f"{n} double" for n in names[:6]) + ", same_source int, version_conflict int")
    got = [r.probability for r in problems.join_probability(rows, fixed.STORY_SCORER).collect()]
    z = -3.5 + 30 * 0.1 + 4 * 0.5 + 3 * 0.4 - 0.03 * 2
    assert math.isclose(got[0], 1 / (1 + math.exp(-z))) and math.isclose(got[1], 1 / (1 + math.exp(6 - z))) and got[2] == pytest.approx(0, abs=1e-20)


def test_softmax_and_decision(spark):
    x = spark.createDataFrame([([1.0, -2.0],)], "f array<double>")
    w, b = [[0.5, 0], [0, 1], [0, 0], [1, 1], [2, 0], [0, -1]], [0.0] * 6
    r = x.select(problems.softmax(F.col("f"), w, b, [0.0, 0.0], [1.0, 1.0]).alias("p")).select("p", problems.decided(F.col("p")).alias("d")).first()
    e = [math.exp(v) for v in (0.5, -2, 0, -1, 2, 2)]
    assert r.p == pytest.approx([v / sum(e) for v in e]) and r.d.is_problem is False and r.d.category == "how_to_question"
    c = lambda *a: spark.range(1).select(problems.decision(*[F.lit(v) for v in a[:1]], a[1], F.lit(a[2]), F.lit(a[3]), F.lit(a[4]), a[5])).first()[0]
    assert [c(None, 0.5, None, None, None, 0.6), c(0.2, 0.5, None, 1, 0.9, 0.6), c(0.9, 0.5, 4, 1, 0.9, 0.6), c(0.9, 0.5, None, 1, 0.9, 0.6), c(0.9, 0.5, None, 1, 0.5, 0.6)] == ["unclassified", "not_problem", "kept", "joined", "created"]


def test_fusion_counts_duplicates_once_and_keeps_ties(spark):
    lex = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3)], "qid int, id long, rank int")
    dense = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "qid int, id long, rank int")
    f = {r.id: r.score for r in retrieval.fused([lex, dense]).collect()}
    assert f == {10: round(1 / 61, 9), 11: round(1 / 62 + 1 / 61, 9), 12: round(1 / 62, 9)}
    owners = spark.createDataFrame([(10, 1), (11, None), (12, 1)], "id long, story_id long")
    hits = retrieval.fused_stories(retrieval.fused([lex, dense]), owners).collect()
    assert [(h.story_id, h.id) for h in hits] == [(1, 10)]
    assert retrieval.search(lex, None, owners).first().degraded is True


def test_trees_and_rerank(spark):
    trees = [{"feature": 0, "threshold": 0.5, "left": {"value": 1.0}, "right": {"feature": 1, "threshold": 2.0, "left": {"value": 2.0}, "right": {"value": 3.0}, "missing": "right"}}, {"value": 0.25}]
    rows = spark.createDataFrame([(0.5, 0.0), (0.6, 2.0), (0.6, 9.0), (0.6, None), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(retrieval.tree_score(trees, ["a", "b"])).collect()] == [1.25, 2.25, 3.25, 3.25, 1.25, 1.25]
    c = spark.createDataFrame([(1, 5, 0.2, 1.0), (1, 4, 0.3, 1.0), (1, 3, 0.3, 1.0), (1, 2, 0.1, 2.0)], "qid int, story_id long, rrf double, m double")
    assert [r.story_id for r in retrieval.reranked(c, F.col("m")).orderBy("rank").collect()] == [2, 3, 4, 5]


def test_bm25_against_the_formula(spark):
    docs = spark.createDataFrame([(1, "solar panel", "solar panel grid cost"), (2, "wind", "wind grid wind"), (3, "", "")], "id long, title string, body string")
    q = spark.createDataFrame([(7, "solar grid")], "qid int, text string")
    got = {r.id: r for r in retrieval.bm25(retrieval.postings(docs), retrieval.corpus_size(docs), q).collect()}
    mean, idf = (8 + 5 + 0) / 3, lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, n, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert got[1].score == round(part(3, 8, 1) + part(1, 8, 2), 6) and got[2].score == round(part(1, 5, 2), 6) and 3 not in got
    assert [r.id for r in retrieval.match_all(retrieval.bm25(retrieval.postings(docs), retrieval.corpus_size(docs), q)).collect()] == [1]


def test_components_of_chains(spark):
    r = random.Random(1)
    nodes = list(range(60))
    chains = [nodes[:25], nodes[25:27], nodes[30:60]]
    edges = [(a, b) if r.random() < 0.5 else (b, a) for c in chains for a, b in zip(c, c[1:])]
    got = {x.id: x.label for x in dedup.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: next((c[0] for c in chains if n in c), n) for n in nodes}
    assert dedup.components(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([], "a long, b long")).collect()[0].label == 1


def test_lsh_pairs_whatever_the_order_of_ids(spark):
    signed = spark.createDataFrame([(i, [1, 2, i], ["p", f"q{i}"]) for i in (1, 2, 3, 4)] + [(5, [9, 9, 9], ["r"])], "id long, signature array<long>, bands array<string>")
    times = spark.createDataFrame([(1, hours(95)), (2, hours(100)), (3, hours(94)), (4, hours(23)), (5, hours(95))], "id long, discovered_at timestamp")
    got = sorted((r.a, r.b) for r in dedup.lsh_pairs(signed, times).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (2, 3), (3, 4)]  # 2 is the first, 4 comes 77 hours after it
    same = times.withColumn("discovered_at", F.lit(NOW))
    assert len(dedup.lsh_pairs(signed, same).collect()) == 6


def test_replay(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    schema = "id long, discovered_at timestamp, source_id string, content_hash string, t array<string>, ver array<string>, bands array<string>, signature array<long>, v array<double>"
    rows = [(1, hours(200), "a", "h1", ["x", "y"], [], ["b"], [1, 2], v), (2, hours(199), "b", "h2", ["x", "y"], [], ["b"], [1, 2], v), (3, hours(198), "c", "h3", ["z"], [], [], [5, 6], w), (4, hours(100), "b", "h4", ["x", "y"], [], ["b"], [1, 2], v), (5, hours(1), "b", "h1", ["x", "y"], [], [], [], v), (6, hours(197), "d", "h6", ["x", "y"], ["1.2"], ["b"], [1, 2], v)]
    got = {r.id: r.story_id for r in dedup.replay(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 1}


def test_replay_keeps_the_window_only():
    state = dedup.Replay(fixed.STORY_SCORER, 72 * 3_600_000_000, 10, 25)
    r, minute = np.random.default_rng(3), 60_000_000
    for i in range(3_000):
        copies, bands = (2, ["late"]) if i in (6, 2_900) else (None, [f"x{i // 2}"])
        story, _ = state.add(i, i * 7 * minute, "s", "copied" if copies else f"h{i}", [f"w{i}"], [], copies, bands, [3 if copies else 2], np.array([i]), r.normal(size=4) if i % 5 else None)
        assert len(state.live) <= 618 and len(state.asleep) <= 1 and len(state.bands) <= 4 and len(state.texts) <= 1
        assert i != 2_900 or story == 6  # a copy that comes long after its original, whose story wakes up with it
    again = state.add(3_000, 2_900 * 7 * minute, "t", "new", ["w6"], [], None, ["late"], [3], np.array([6]), state.live[6].centre)
    assert again[0] == 6 and again[1] > 0.9 and not state.texts and "late" not in state.bands
    assert state.add(3_001, None, "t", "null time", ["w5"], [], None, None, None, None, None) == (3_001, None) and not state.live


def test_nearest_owner_against_expressions(spark, monkeypatch):
    r = random.Random(5)
    nan, some = float("nan"), [[r.gauss(0, 1) for _ in range(5)] for _ in range(30)]
    odd = [None, [0.0] * 5, [], [1.0, None, 1.0, 1.0, 1.0], [1.0, 2.0], [nan, 1.0, 1.0, 1.0, 1.0], [1e200] * 5, [1e-200] * 5, some[3], [2 * x for x in some[4]], [1e-3 + 5e-7, 1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0]]
    x = spark.createDataFrame([(i, r.choice([None, *range(9)]), v) for i, v in enumerate(some + odd)], "id long, at long, v array<double>")
    monkeypatch.setattr(retrieval, "TILE", 70)
    for owned, timed, components in ((some[:20] + odd, True, 100), (some[:20] + odd, False, 1 << 20), (odd[:5], True, 1 << 20), (some[:1] * 40, True, 1 << 20), ([], True, 1 << 20)):
        monkeypatch.setattr(retrieval, "OWNER_COMPONENTS", components)
        o = spark.createDataFrame([(100 - i, r.choice([None, *range(9)]), v) for i, v in enumerate(owned)], "owner long, since long, ov array<double>")
        both = x.join(o, F.expr("since <= at" if timed else "true")).withColumn("similarity", F.round(cosine(F.col("v"), F.col("ov")), 6))
        best = F.max_by(F.struct("owner", "similarity"), F.struct(F.col("similarity"), -F.col("owner"))).alias("x")
        want = both.groupBy("id").agg(best).select("id", "x.*").collect()
        assert sorted(map(str, retrieval.nearest_owner(x, o, timed).collect())) == sorted(map(str, want))


def test_nearest_against_expressions(spark, monkeypatch):
    r = random.Random(6)
    nan, some = float("nan"), [[r.gauss(0, 1) for _ in range(5)] for _ in range(30)]
    odd = [None, [0.0] * 5, [], [1.0, None, 1.0, 1.0, 1.0], [1.0, 2.0], [nan, 1.0, 1.0, 1.0, 1.0], [1e200] * 5, [1e-200] * 5, [1e-161, 2e-162, 0.0, 0.0, 0.0], some[3], [2 * x for x in some[4]]]
    halves = [[float(x == y) for y in range(5)] for x in range(2)] + [[1 / 128, (1 - 2**-14) ** 0.5, 0.0, 0.0, 0.0], [-3 / 128, 0.0, (1 - 9 / 2**14) ** 0.5, 0.0, 0.0], [1e-3 + 5e-7, 1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]]
    monkeypatch.setattr(retrieval, "TILE", 70)
    for stated, block, tasks, k in ((some + odd + halves, 12, 300, 4), (some[:9] * 4, 2_000, 200, 100), (odd + halves, 2_000, 10**6, 1), (halves + some[:1] * 40, 2_000, 10**6, 4), (odd[3:4] * 9, 5, 10**6, 100), ([], 5, 5, 1)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        monkeypatch.setattr(retrieval, "TASK_PAIRS", tasks)
        rows = [(i if i < 40 else i // 2, v) for i, v in enumerate(stated)]
        r.shuffle(rows)
        x = spark.createDataFrame([*rows, (None, some[0])], "vec_id long, embedding array<double>")
        asked = x.where("vec_id % 3 = 0 or vec_id is null").toDF("qid", "q")
        pairs = x.join(asked, F.expr("vec_id <> qid and embedding is not null and q is not null"))
        pairs = pairs.select("qid", F.col("vec_id").alias("id"), F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
        want = retrieval.top(pairs, "qid", "similarity", "id", k).collect()
        assert sorted(map(str, retrieval.nearest(x, asked, k).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("name", ("knn_top", "judging_pool", "rrf_fused", "stories_fused", "hybrid_fused", "hybrid_stories", "rerank_features"))
def test_dense_search_joins_no_pairs(spark, monkeypatch, name):
    plans, whole = [], retrieval.nearest
    monkeypatch.setattr(retrieval, "nearest", lambda *a: plans.append(whole(*a)) or plans[-1])
    queries.ALL[name](spark, SF)
    plan = plans[0]._jdf.queryExecution().toString()
    assert len(plans) == 1 and "NestedLoop" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan


def test_story_problem_links_joins_no_pairs(spark):
    plan = queries.ALL["story_problem_links"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "MapInArrow" in plan


def test_validation_and_claims(spark):
    lines = spark.createDataFrame([(json.dumps({"id": "1", "type": "t"}),), ("{broken",), (json.dumps({"id": "1", "extra": 2}),)], "value string")
    rows = ingest.parsed(lines, schemas.envelope(schemas.EXTRACTED))
    good, bad = ingest.split(rows)
    assert good.count() == 1 and sorted(r.errors[0] for r in bad.collect()) == ["json", "unknown_field"]
    data = {"title": "t", "lede": "l", "lang": "en", "content_origin": "page", "word_count": 3}
    events = [{"subject": "a" * 64, "idempotency_key": "b" * 64, "time": "2024-01-01T00:00:00Z", "data": data}, {"subject": "x", "data": {**data, "lang": "EN", "doc_kind": "discussion"}}]
    checked = ingest.checked(ingest.parsed(spark.createDataFrame([(json.dumps(e),) for e in events], "value string"), schemas.envelope(schemas.EXTRACTED)), ingest.envelope_rules()).collect()
    assert [r.errors for r in checked] == [[], ["doc_kind", "idempotency_key", "lang", "subject", "time"]]
    e = spark.createDataFrame([("k", 2, "late"), ("k", 1, "first"), ("m", 3, "x")], "key string, n int, v string")
    assert sorted((r.key, r.v) for r in ingest.claimed(e, "key", ["n"]).collect()) == [("k", "first"), ("m", "x")]
    assert [r.key for r in ingest.claimed(e, "key", ["n"], spark.createDataFrame([("k",)], "key string")).collect()] == ["m"]
    u = ingest.upserted(spark.createDataFrame([(1, 1, "seen", "old"), (1, 2, "later", None)], "id int, n int, first string, v string"), "id", ["n"], ["first"]).first()
    assert u.first == "seen" and u.v is None and u.n == 2


def test_scans(spark):
    i = spark.createDataFrame([(1, "t", "a <!-- x\ny --> b", "bob", None), (2, "t", "x", "dep[bot]", None), (3, "t", "x", "al", True)], "id int, title string, body string, author string, is_pull_request boolean")
    assert [(r.id, r.text) for r in ingest.issues(i).collect()] == [(1, "t. a b")]
    packed = ingest.packed_queries([f"owner/repo{n}" for n in range(40)], "is:issue")
    assert all(len(p) <= 256 for p in packed) and sum(p.count("repo:") for p in packed) == 40
    tags = spark.createDataFrame([(1, 5, hours(10), "a"), (2, 9, hours(10), "b"), (3, 9, hours(1), "c"), (4, 1, hours(10), "d")], "id int, score int, created_at timestamp, title string")
    assert [r.id for r in ingest.tagged_items([tags, tags], 3, F.lit(NOW), 2, 48).collect()] == [2, 1]
    page = spark.createDataFrame([("<title>T &amp; x</title><nav>n</nav><article><p>one <b>two</b></p><script>no()</script></article><footer>f</footer>",)], "h string").select(ingest.page_document(F.col("h")).alias("d")).first().d
    assert (page.title, page.text, page.word_count) == ("T & x", "one two", 2)


def test_metrics(spark):
    ranking_ = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid int, id long, rank int")
    qrels = spark.createDataFrame([(1, 10, 0), (1, 11, 3), (1, 13, 2), (2, 10, 3), (3, 9, 0)], "qid int, id long, grade int")
    m = {r.qid: r for r in evaluation.ranking_metrics(ranking_, qrels).collect()}
    assert m[1].ndcg == pytest.approx((7 / math.log2(3)) / (7 + 3 / math.log2(3))) and (m[1].recall, m[1].mrr) == (0.5, 0.5)
    assert (m[2].ndcg, m[2].mrr, m[3].ndcg) == (0, 0, 0)
    low, high = spark.range(1).select(evaluation.wilson(F.lit(15), F.lit(48)).alias("w")).first().w
    assert (round(low, 3), round(high, 3)) == (0.199, 0.453)
    scored = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.1, 0)], "score double, gold int")
    curve = evaluation.threshold_curve(scored)
    assert evaluation.chosen_threshold(curve).first().threshold == 0.6 and evaluation.chosen_threshold(curve, 0.9).first().threshold == 0.8
    b = evaluation.bootstrap_interval(spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "i long, value double"), 200).first()
    assert b.low < b["mean"] == 0.5 < b.high
    f = evaluation.folds(spark.createDataFrame([(i, i % 2) for i in range(40)], "id int, s int"), "id", 5, "s").groupBy("s", "fold").count().collect()
    assert {r["count"] for r in f} == {4}
    assert evaluation.regressed({"a": 0.79, "b": 0.5}, {"a": 0.805, "b": 0.505}) == ["a"]
    model = {"schema": evaluation.schema_hash({"f": ["a"]})}
    assert evaluation.guarded(model, {"f": ["a"]}) is model
    with pytest.raises(ValueError):
        evaluation.guarded(model, {"f": ["b"]})


def test_logistic_fit_in_raw_units(spark):
    r = random.Random(2)
    rows = [(x := r.gauss(5, 2), y := r.gauss(-1, 0.5), float(r.random() < 1 / (1 + math.exp(-(1.5 * x + 2 * y - 5.5))))) for _ in range(2000)]
    w = evaluation.fitted_logistic(spark.createDataFrame(rows, "x double, y double, label double"), ["x", "y"], "label", 0.0)
    assert w["x"] == pytest.approx(1.5, abs=0.3) and w["y"] == pytest.approx(2, abs=0.6) and w["intercept"] == pytest.approx(-5.5, abs=1.2)


def test_map_layout_separates_clusters():
    import numpy as np

    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.1, (30, 8)) for c in (0, 3, -3)])
    y = views.layout(x)
    own = views.islands(y, 3)
    assert all(len(set(own[i : i + 30])) == 1 for i in (0, 30, 60)) and len(set(own)) == 3
    assert np.array_equal(y, views.layout(x)) and views.layout(x[:1]).shape == (1, 2) and views.layout(x[:3]).shape == (3, 2)
    near = lambda z: np.argsort(((z[:, None] - z) ** 2).sum(2) + np.eye(len(z)) * 1e9, 1)[:, :10]
    kept = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near(x), near(y))])
    assert kept > 0.45  # of ten neighbours; by chance 0.11, within the right cluster 0.34
    p = views._neighbour_weights(x, 20.0)
    assert np.allclose(p, p.T) and abs(p.sum() - 1) < 1e-6
    assert len(set(views.islands(np.zeros((6, 2)), 3))) == 1 and len(set(views.islands(np.arange(8.0).reshape(4, 2), 9))) == 4


def test_pulse_has_every_bucket(spark):
    rows = spark.createDataFrame([(hours(0.5), "a"), (hours(3.2), "a"), (hours(99), "b")], "t timestamp, k string")
    p = views.pulse(rows, "t", "k", F.lit(NOW), 5).collect()
    assert len(p) == 10 and sum(r.n for r in p) == 2 and max(r.hour for r in p) == NOW


NAMES = sorted(oracles.ALL)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    mine = queries.ALL[name](spark, SF)
    cur = duck.execute(oracles.ALL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(mine.columns)
    want = sorted(tuple(map(norm, r)) for r in cur.fetchall())
    assert sorted(tuple(map(norm, r)) for r in mine.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.ALL) - set(oracles.ALL)))
def test_other_queries_run(spark, name):
    assert queries.ALL[name](spark, SF).count() > 0


def test_hot_paths_stay_in_generated_code(spark):
    for name in ("feed_scores", "bm25_top", "minhash_bands", "problem_summary"):
        plan = queries.ALL[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    plan = queries.ALL["upsert_latest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id" in plan and "ts:" not in plan.split("ReadSchema")[1]


def test_all_terms_are_asked_before_any_cut(spark, monkeypatch):
    rows = [(i, "", "alpha") for i in range(9)] + [(9, "", "alpha beta " + "filler " * 400)]
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    asked = spark.createDataFrame([(1, "alpha beta")], "qid long, text string")
    depths, whole = [], retrieval.bm25
    monkeypatch.setattr(queries, "_index", lambda spark, sf: (retrieval.postings(docs), retrieval.corpus_size(docs), asked))
    monkeypatch.setattr(retrieval, "bm25", lambda *a, depth=retrieval.DEPTH: depths.append(depth) or whole(*a, depth=depth))
    assert [(r.id, r["rank"]) for r in queries.and_match(spark, SF).collect()] == [(9, 1)] and depths == [None]
