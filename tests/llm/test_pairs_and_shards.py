"""Near duplicates, shards and decontamination against brute force."""

import random
import re
import zlib

import numpy as np

from storyloom.llm import decontam, neardup, sharding

DOCS = "doc_id long, text string, source string"


def shingle_set(text, k=5):
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_components(docs, percent):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, []).append(shingle_set(t))
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x & y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def planted(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    docs, n = [], 0
    for size in (6, 9, 30, 200):
        base = [word() for _ in range(size)]
        chain = list(base)
        for step in range(12):  # a chain whose ends aren't alike
            docs.append((n, " ".join(chain)))
            n += 1
            chain = list(chain)
            at = r.randrange(len(chain))
            chain[at : at + max(1, size // 60)] = [word()]
        for _ in range(25):  # copies at a middle similarity, all in the same buckets
            other = list(base)
            for _ in range(max(1, size // 40)):
                other[r.randrange(size)] = word()
            docs.append((n, " ".join(other)))
            n += 1
        docs += [(n + k, " ".join(base).upper() if k % 2 else "\n".join(base)) for k in range(5)]
        n += 5
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One\ttwo"), (n + 5, "one two three"), (n + 6, "x" * 200_000)]


def test_components_match_brute_force(spark):
    docs = planted()
    for percent in (80, 85):
        found = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()}
        want = brute_components(docs, percent)
        assert {i: r.component_id for i, r in found.items()} == want
        assert all(r.kept == (r.component_id == r.doc_id) for r in found.values())
        assert all(r.n_shingles == len(shingle_set(dict(docs)[i])) for i, r in found.items())


def test_blocks_hold_all_links(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 900)
    docs = planted(2)
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()}
    assert found == brute_components(docs, 85)


def test_matrix_and_sets_agree():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[r.random(60) < 0.93], r.integers(0, 1 << 60, 3, dtype=np.uint64)))) for _ in range(40)]
    labels = list(range(40))

    def groups(pairs, n):
        own = list(range(n))
        for a, b in pairs:
            x, y = own[a], own[b]
            own = [min(x, y) if o in (x, y) else o for o in own]
        return own

    small = [(a, b) for a in range(40) for b in range(a + 1, 40) if neardup.block_links([a, b], [sets[a], sets[b]], 80)]
    assert groups(neardup.block_links(labels, sets, 80), 40) == groups(small, 40)


def test_repeated_ids_nulls_and_other_columns(spark):
    rows = [(1, "a b c d e f", "x", 5), (1, "q r s t u v", "y", 5), (2, "a b c d e f", "x", 5), (3, "q r s t u v", None, 5), (None, "a b c d e f", "x", 5), (None, "only here now", "x", 5), (9, "p p", "x", 5), (9, "p p", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n int")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (9, 9, True), (9, 9, True)], key=str)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b c d e f"), ("1", "q r s t u v"), ("9", "p p"), ("None", "only here now")]
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_pipeline_keeps_rows_without_a_copy(spark):
    import corpus_pipeline

    rows = [(None, "only here now", "x"), (None, "a b c d e f", "x"), (2, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "q r s t u v", "y"), (3, "q r s t u v", None), (5, "m n o p q", "x"), (5, "i j k l m", "x"), (9, "p p", "x"), (9, "p p", "x"), (None, "z z", "x"), (None, "z z", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(None, "only here now"), (1, "a b c d e f"), (1, "q r s t u v"), (5, "m n o p q"), (5, "i j k l m"), (9, "p p"), (None, "z z")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_densified_signatures_estimate_similarity():
    r, order = np.random.default_rng(5), neardup._borrowing_order(144)
    for n in (8, 60, 2000):
        same = []
        for _ in range(60):
            pool = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(pool[: int(n * 0.95)]), np.sort(pool[int(n * 0.05) :])
            same.append((neardup.one_permutation(a, 144, order) == neardup.one_permutation(b, 144, order)).mean())
        a, b = int(n * 0.95), n - int(n * 0.05)
        assert abs(np.mean(same) - (a + b - n) / n) < 0.06


def test_shards_match_the_mixture(spark):
    r = random.Random(4)
    sources = ["hot"] * 700 + [f"s{r.randrange(9)}" for _ in range(500)] + [None] * 11
    docs = [(i, f"text {i}" * r.randrange(4) or None, s) for i, s in enumerate(sources)] + [(None, "x", "hot"), (5, "again", "s1"), (5, "again", "s1")]
    frame = spark.createDataFrame(docs, DOCS)
    rows = sharding.stratified_shards(frame, 24).collect()
    assert len(rows) == len(docs)
    by = {}
    for x in rows:
        by.setdefault(x.shard, []).append(x)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x.slot for x in shard) == list(range(len(shard))) for shard in by.values())
    for s in set(sources):
        counts = [sum(x.source == s for x in shard) for shard in by.values()]
        assert max(counts) - min(counts) <= 4
    # the order against a plain sort
    whole = sorted(rows, key=lambda x: (x.shard, x.slot))
    assert [x.fraction for x in whole] == sorted(x.fraction for x in whole)
    text = {i: t or "" for i, t, _ in docs if i not in (None, 5)}
    assert all(x.crc == zlib.crc32(text[x.id].encode()) and x.bytes == len(text[x.id].encode()) for x in rows if x.id in text)
    again = sharding.stratified_shards(frame.repartition(7), 24).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sharding.stratified_shards(frame.limit(0), 24).collect() == []
    few = sharding.stratified_shards(frame.limit(3), 24).collect()
    assert len(few) == 3 and all(x.slot == 0 for x in few)


def items():
    r = random.Random(6)
    word = lambda: "".join(r.choice("lmnopqrst") for _ in range(r.randint(3, 7)))
    common = ["the", "of", "and", "to", "in"]
    make = lambda n: " ".join(r.choice(common) if r.random() < 0.4 else word() for _ in range(n))
    return [(i, f"{make(r.randint(8, 40))}. {make(r.randint(4, 15))}.") for i in range(60)], make


def test_retrieval_is_exhaustive():
    tests, make = items()
    words = [decontam.plain_words(t) for _, t in tests]
    df = {}
    for w in words:
        for t in np.unique(w).tolist():
            df[t] = df.get(t, 0) + 1
    index = decontam.ItemIndex(tests, len(tests), sum(map(len, words)) / len(words), df, max(map(len, words)))
    dense = np.zeros((len(index.terms), len(tests)))
    for k in range(len(index.terms)):
        dense[k, index.rows[index.start[k] : index.start[k + 1]]] = index.weights[index.start[k] : index.start[k + 1]]
    assert np.allclose(dense.sum(0), 1)
    for n, (_, text) in enumerate(tests):
        ids = np.unique(index.term_ids(decontam.plain_words(text[: len(text) // (n % 3 + 1)] + make(30))))
        ids = ids[ids >= 0]
        for threshold in (0.05, 0.2, 0.5):
            scores = dense[ids].sum(0)
            got = dict(index.retrieve(ids, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())
            assert all(abs(scores[r] - s) < 1e-9 for r, s in got.items())


def test_planted_items_are_found_and_clean_documents_stay(spark, monkeypatch):
    tests, make = items()
    docs = [(i, make(r)) for i, r in enumerate([5, 50, 400, 1500] * 10)]
    dirty = {}
    for n, (item, text) in enumerate(tests):
        doc = 100 + n
        dirty[doc] = item
        changed = text.upper() if n % 3 == 1 else text.replace(" ", "\n") if n % 3 == 2 else text
        docs.append((doc, make(n * 7) + " " + changed + " " + make(n * 3)))
    docs += [(900, None), (901, ""), (902, "...")]
    frame = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([*tests, (77, None), (78, ""), (None, "no id here at all")], "item_id long, text string")
    for items_each, stride in ((20_000, 64), (13, 64), (20_000, 4)):
        monkeypatch.setattr(decontam, "ITEMS", items_each)
        monkeypatch.setattr(decontam, "STRIDE", stride)  # several classes of length
        hits = decontam.contaminated(frame, benchmark).collect()
        assert {(h.doc_id, h.item_id) for h in hits} == set(dirty.items())
        clean = decontam.without_hits(frame, benchmark)
        assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - set(dirty)
    assert decontam.contaminated(frame.limit(0), benchmark).collect() == [] and decontam.contaminated(frame, benchmark.limit(0)).collect() == []


def test_items_without_an_id_are_found(spark):
    item = "which river runs past the old mill at dawn. the quiet silver stream."
    docs = spark.createDataFrame([(1, "some words before " + item + " and after", "x"), (2, "nothing of that kind here", "x")], DOCS)
    benchmark = spark.createDataFrame([(None, item), (None, None), (4, "another question altogether. its answer is here.")], "item_id long, text string")
    assert [(h.doc_id, h.item_id) for h in decontam.contaminated(docs, benchmark).collect()] == [(1, None)]
    named = benchmark.selectExpr("concat('item ', coalesce(item_id, 0)) as item_id", "text")
    assert [(h.doc_id, h.item_id) for h in decontam.contaminated(docs, named).collect()] == [(1, "item 0")]
    assert [r.doc_id for r in decontam.without_hits(docs, benchmark).collect()] == [2]
