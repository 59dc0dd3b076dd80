"""Text, URL, hash and vector functions on literal cases and properties."""

import hashlib
import math
import re

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyloom import fixed
from storyloom.functions import hashing, text, urls, vectors


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        # a rule each: fragment, tracking parameters, scheme and host in lower case but not the path
        ("https://river.test/notes#part-2", "https://river.test/notes"),
        ("https://river.test/n?utm_term=q&gclid=7&MKT_TOK=8", "https://river.test/n"),
        ("HtTpS://RIVER.test/Notes/One", "https://river.test/Notes/One"),
        # leading labels, default and other ports, plain http, trailing dot
        ("https://www.amp.river.test/n", "https://river.test/n"), ("https://wwwriver.test/n", "https://wwwriver.test/n"),
        ("https://river.test:443/n", "https://river.test/n"), ("https://river.test:9000/n", "https://river.test:9000/n"), ("http://river.test/n", "https://river.test/n"), ("https://river.test./n", "https://river.test/n"),
        # path ends, the empty path
        ("https://river.test/n/amp/", "https://river.test/n"), ("https://river.test/n//", "https://river.test/n"), ("https://river.test?x=1", "https://river.test/?x=1"),
        # parameters in order, without a value, escapes
        ("https://river.test/n?zeta=1&alpha=2&alpha=1", "https://river.test/n?alpha=1&alpha=2&zeta=1"), ("https://river.test/n?flag", "https://river.test/n?flag="), ("https://river.test/%C3%A9?k=%20v", "https://river.test/%C3%A9?k=+v"),
        ("\thttps://river.test/n \n", "https://river.test/n"),
        # refused
        ("mailto:a@river.test", None), ("data:text/plain,x", None), ("river.test/n", None), ("https://me:pw@river.test/", None), ("http://", None), ("", None), (None, None), ("https://riv er.test/", None),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, raw, urls.canonical_url) == want
    if want:
        assert one(spark, want, urls.canonical_url) == want


def test_idn_and_sites(spark):
    assert one(spark, "https://bücher.example/ä", lambda c: urls.canonical_url(urls.ascii_host(c))) == "https://xn--bcher-kva.example/ä"
    rows = spark.createDataFrame([("https://a.b.co.uk/x", "https://www.b.co.uk/y"), ("https://a.com/x", "https://b.com/x"), ("https://a.com/x", None)], "f string, d string")
    got = [r[0] for r in rows.select(urls.chosen_canonical(F.col("f"), F.col("d"))).collect()]
    assert got == ["https://b.co.uk/y", "https://a.com/x", "https://a.com/x"]


def test_canonical_is_idempotent(spark):
    parts = st.builds(lambda s, h, p, q: s + h + p + q, st.sampled_from(["http://", "https://www.", "HTTPS://AMP."]), st.from_regex(r"[a-zA-Z0-9.-]{1,12}", fullmatch=True), st.from_regex(r"(/[a-z%~]{0,5}|/amp){0,3}/?", fullmatch=True), st.from_regex(r"(\?([a-z]{1,3}(=[a-z%+* ]{0,3})?&?){0,3})?", fullmatch=True))

    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(parts, min_size=40, max_size=40))
    def check(raw):
        c = urls.canonical_url
        rows = spark.createDataFrame([(u,) for u in raw], "x string").select(c(F.col("x")).alias("y")).select("y", c(F.col("y")).alias("z")).collect()
        assert all(r.y == r.z for r in rows)

    check()


def test_tokens_keep_versions_whole(spark):
    assert one(spark, "GPT-5.1 beats v0.29.0 — it’s NEW", text.tokens) == ["gpt-5.1", "beats", "v0.29.0", "it", "s", "new"]
    assert one(spark, "The release of GPT-5.1 is x", text.content_tokens) == ["release", "gpt-5.1"]


@pytest.mark.parametrize(("title", "want"), [("Release v1.37.0-rc.1 now", ["1.37.0-rc.1"]), ("llama build b10938", ["b10938"]), ("plain words", []), ("3.8 vs 3.9", ["3.8", "3.9"]), ("commit 0123456789abcdef", ["0123456789abcdef"]), ("route66 a1.2b", [])])
def test_versions(spark, title, want):
    assert one(spark, title, text.version_tokens) == want


def test_headlines(spark):
    assert one(spark, "[Roadmap] Feature Request: Support fast widgets", text.headline_tokens) == ["fast", "widgets"]
    assert "qwen3.8" in one(spark, "support Qwen3.8 with fp8", text.problem_version_tokens) and "fp8" not in one(spark, "support Qwen3.8 with fp8", text.problem_version_tokens)


@pytest.mark.parametrize(
    ("body", "label"),
    [("It crashes with an error", "bug_or_reliability"), ("far too expensive and slow", "cost_or_performance"), ("is there a way, would be nice", "missing_capability"),
     ("this is tedious", "workflow_friction"), ("how do I start", "how_to_question"), ("great post, thanks for sharing", "not_a_problem"), ("great post but it crashed with a bug", "bug_or_reliability"), ("", "not_a_problem")],
)
def test_rule_labels(spark, body, label):
    assert one(spark, body, text.rule_label) == label


def test_cue_patterns_count_like_python(spark):
    body = "Errors? An ERROR, errors; it fails, failed. How do we... how to? I wish; is there any bill billing"
    for group, pattern in fixed.CUES.items():
        assert one(spark, body, lambda c, g=group: text.cue_count(c, g)) == len(re.findall(pattern, body, re.I))


def test_shingles(spark):
    f = lambda c: text.shingles(F.split(c, " "))
    assert one(spark, "a b c d", f) == ["a b c", "b c d"] and one(spark, "a b", f) == ["a", "b"] and one(spark, "a a a a", f) == ["a a a"]


def test_excerpt_and_cleanup(spark):
    assert one(spark, "  a \n b  ", lambda c: text.excerpt(c, 10)) == "a b"
    assert one(spark, "alpha beta gamma", lambda c: text.excerpt(c, 12)) == "alpha beta…"
    assert one(spark, "<p>a &amp;lt; b</p> c&nbsp;d", text.strip_tags) == "a &lt; b c d"
    assert [one(spark, w, text.fold_plural) for w in ("agents", "class", "gas", "agent")] == ["agent", "class", "gas", "agent"]


def test_language(spark):
    assert one(spark, "the cat is in the house and that is it for the day, to be on time of course", text.detect_language) == "en"
    assert one(spark, "der Hund ist in dem Haus und die Katze ist nicht mit ein Tier von den anderen", text.detect_language) == "de"
    assert one(spark, "short", text.detect_language) == "und"
    rows = spark.createDataFrame([("short", "EN"), ("short", "english"), ("short", None)], "t string, d string")
    assert [r[0] for r in rows.select(text.detect_language(F.col("t"), F.col("d"))).collect()] == ["en", "und", "und"]


def test_gazetteer(spark):
    names = [("py", ["Python", "python language"], False), ("go", ["Go"], True), ("c", ["C++"], False)]
    f = lambda c: text.gazetteer(c, names)
    assert one(spark, "PYTHON LANGUAGE and Go, c++", f) == ["c", "go", "py"] and one(spark, "let go of pythons", f) == [] and one(spark, "", f) == []


def test_parsed_query(spark):
    p = one(spark, "Latest  GPT-5.1\n release " + "x" * 300, text.parsed_query)
    assert p.recency and p.versions == ["5.1"] and len(p.text) <= 256 and p.tokens[0] == "latest"


def test_compatibility_forms(spark):
    assert one(spark, "ﬁne ２", lambda c: text.normalize(text.compatibility(c))) == "fine 2"


def test_keys(spark):
    want = hashlib.sha256(b"extracted|a|h").hexdigest()
    assert one(spark, "a", lambda c: hashing.idempotency_key(F.lit("extracted"), c, F.lit("h"))) == want
    assert one(spark, " Bob ", lambda c: hashing.author_hash("s", F.lit("hn"), c)) == hashlib.sha256(b"s|hn|bob").hexdigest()
    assert one(spark, "", lambda c: hashing.author_hash("s", F.lit("hn"), c)) is None and one(spark, "x", lambda c: hashing.author_hash("", F.lit("hn"), c)) is None


def test_minhash_estimates_jaccard(spark):
    a = [f"w{i}" for i in range(400)]
    rows = [(1, a), (2, a), (3, a[100:] + [f"v{i}" for i in range(100)]), (4, [f"u{i}" for i in range(400)])]
    df = hashing.minhash(spark.createDataFrame(rows, "id long, s array<string>"), "id", "s")
    sig = {r.id: r.signature for r in df.collect()}
    same = lambda x, y: sum(p == q for p, q in zip(sig[x], sig[y])) / 64
    assert same(1, 2) == 1 and abs(same(1, 3) - 0.6) < 0.2 and same(1, 4) < 0.1
    keys = {r.id: r.k for r in df.select("id", hashing.band_keys(F.col("signature")).alias("k")).collect()}
    assert keys[1] == keys[2] and not set(keys[1]) & set(keys[4])
    rates = [round(one(spark, s, lambda c: hashing.collision_rate(c, 4, 16), "double"), 2) for s in (0.3, 0.5, 0.7)]
    assert rates == [0.12, 0.64, 0.99]


def test_minhash_of_rows_in_batches(spark, monkeypatch):
    rows = [(1, ["a", None, "b"]), (2, []), (3, None), (1, ["c"]), (None, ["d"]), (4, [f"x{i}" for i in range(50)])]
    monkeypatch.setattr(hashing, "HASHES", 3)
    df = hashing.minhash(spark.createDataFrame(rows, "id long, s array<string>"), "id", "s")
    x = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16) % hashing.PRIME
    want = {k: [min((x(t) * a + b) % hashing.PRIME for t in s) for a, b in hashing.coefficients()] for k, s in ((1, "abc"), (None, "d"), (4, rows[5][1]))}
    assert {r.id: r.signature for r in df.collect()} == want
    edge = [0, 1, hashing.PRIME - 1, hashing.PRIME - 2]
    _, least = hashing.minima(pa.array([[v] for v in edge]))
    assert least.tolist() == [[(v * a + b) % hashing.PRIME for a, b in hashing.coefficients()] for v in edge]
    assert "Generate" not in df._jdf.queryExecution().toString()  # no row a shingle


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "k int, v array<double>")
    assert [r[0] for r in rows.select(vectors.norm(F.col("v"))).collect()] == [5.0, 2.0, 0.0]
    assert rows.where("k = 2").select(vectors.unit(F.col("v"))).first()[0] == [0.0, 0.0]
    c = {r.k: r.centroid for r in vectors.centroids(rows, "k", "v").collect()}
    assert math.isclose(c[1][0], 0.6 / math.hypot(0.6, 1.8)) and c[2] == [0.0, 0.0]


def test_jaccard_of_empty_is_zero(spark):
    rows = spark.createDataFrame([(["a"], []), ([], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in rows.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1 / 3]
