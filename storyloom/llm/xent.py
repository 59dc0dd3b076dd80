"""Cross-entropy difference of documents between a target and a background language model.

Both are bigram models over one vocabulary, all words of the documents and of the target (a text's border is a word
too), with one smoothing: (c(v, w) + MASS * p(w)) / (c(v) + MASS), p an add-one unigram over the vocabulary, WORDS
words at least. They are matched in size: background counts are scaled down to the target's number of tokens. A
document's score is its loss per token under the target less that under the background; below 0 it is closer to the
target.

No word or bigram is left out. Words and their counts are a table that grows with the input. The pairs of the WORDS
most frequent words are counted in arrays and broadcast; each other pair has a rarer word, goes to that word's bucket
in packed arrays, and is counted and scored there: so no bucket's load hangs on a frequent word. A word occurs as often
on the right of a pair as on the left, so that its bucket also knows c(w) and p(w). Sums by document come back.

Defined cases: a null or empty text, or one without words, has no tokens and null losses; words are lower case, ASCII
punctuation left out; rows of the target count each, repeated ids too; with an empty target its model is the smoothing
alone; an empty table gives an empty result. The documents are read several times and must come in the same order and
partitions, as a stored table's do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import PLAIN, cut, map_batches, mix64, shared_value, utf8_arrays, word_hashes

#: Words of the broadcast arrays of WORDS^2, with a place for all rarer words (0) and the border (the last).
WORDS = 2048
#: Pseudo-counts of the unigram behind every context.
MASS = 200.0
#: A task's word counts are given out once it holds so many words.
HELD = 4_000_000
#: Tokens of a bucket of pairs with a rarer word, about.
BUCKET = 500_000
_MORE = np.uint64(0x9E3779B97F4A7C15)


def _plain(data: np.ndarray) -> np.ndarray:
    return word_hashes(np.frombuffer(data.tobytes().decode("utf-8", "replace").lower().encode("utf-8"), np.uint8), PLAIN)[0]


def word_counts(docs: DataFrame, text_column: str, name: str) -> DataFrame:
    """The word counts of every task's input: word (null for the border: texts with words), and the count as `name`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            texts = sum(len(x) > 0 for x in held)
            border = np.arange(len(words) + 1) == len(words)
            return pa.RecordBatch.from_arrays([pa.array(np.append(words.view(np.int64), 0), mask=border), pa.array(np.append(n, texts))], ["word", "n"])

        for batch in batches:
            for data in utf8_arrays(batch.column(0)):
                held.append(_plain(data))
                if len(held) % 64 == 0 and sum(map(len, held)) >= HELD:
                    yield out()
                    held = []
        if held:
            yield out()

    return docs.select(text_column).transform(map_batches, count, "word bigint, n bigint").select("word", F.col("n").alias(name))


def pairs(text: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's words between two borders: hashes (0 for a border), and places among the frequent words; empty without words."""
    words = _plain(text)
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ids, hashes = np.zeros(len(words) + 2, np.int64), np.zeros(len(words) + 2, np.uint64)
    hashes[1:-1] = words
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        ids[1:-1] = np.where(frequent[at] == words, at + 1, 0)
    ids[0] = ids[-1] = WORDS - 1
    return hashes, ids


def _frequent_codes(ids: np.ndarray) -> np.ndarray:
    """The codes v * WORDS + w of the bigrams of two frequent words."""
    v, w = ids[:-1], ids[1:]
    both = (v > 0) & (w > 0)
    return v[both] * WORDS + w[both]


def _counted(docs: DataFrame, text_column: str, frequent: np.ndarray, name: str) -> DataFrame:
    """Every task's counts of bigrams of frequent words: code, and the count in the column `name`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = None, [], 0
        for batch in batches:
            for data in utf8_arrays(batch.column(0)):
                held.append(_frequent_codes(pairs(data, frequent)[1]))
                n += len(held[-1])
                if n >= HELD:
                    part = np.bincount(np.concatenate(held), minlength=WORDS * WORDS)
                    total, held, n = part if total is None else total + part, [], 0
        if held:
            part = np.bincount(np.concatenate(held), minlength=WORDS * WORDS)
            total = part if total is None else total + part
        if total is not None:
            codes = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], ["code", "n"])

    return docs.select(text_column).transform(map_batches, count, "code int, n bigint").select("code", F.col("n").alias(name))


class Models:
    """What is of bounded size of the target (0) and the background (1): totals, scales, frequent words and their pairs."""

    def __init__(self, words: DataFrame) -> None:
        """words: word, t, b, with the border as null."""
        size = words.agg(F.count("word").alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b")).first()
        top = words.where("word is not null").orderBy(F.desc("b"), "word").limit(WORDS - 2).collect()
        top.sort(key=lambda r: r["word"] % (1 << 64))
        border = words.where("word is null").first()
        self.frequent = np.array([r["word"] for r in top], np.int64).view(np.uint64)
        self.tokens = [size["t"] or 0, size["b"] or 0]
        self.scale = [1.0, self.tokens[0] / self.tokens[1] if self.tokens[0] and self.tokens[1] else 1.0]
        self.norm = [s * n + max(WORDS, size["n"] + 1) for s, n in zip(self.scale, self.tokens)]
        self.context, self.smooth, self.pair = [], [], []
        for k, name in enumerate(("t", "b")):
            c = np.zeros(WORDS)
            c[1 : len(top) + 1] = [r[name] for r in top]
            c[-1] = border[name] if border else 0
            c *= self.scale[k]
            self.context.append(np.log(c + MASS))
            self.smooth.append(MASS * (c + 1.0) / self.norm[k])

    def set_pairs(self, code: np.ndarray, counts: list[np.ndarray]) -> None:
        for k, n in enumerate(counts):
            c = np.zeros(WORDS * WORDS)
            c[code] = n * self.scale[k]
            self.pair.append(np.log(c.reshape(WORDS, WORDS) + self.smooth[k]).astype(np.float32).ravel())


def fit(docs: DataFrame, target: DataFrame, text_column: str = "text") -> Models:
    """Counts of all words, and of the bigrams of the frequent ones."""
    zero = F.lit(0).cast("bigint")

    def both(count) -> DataFrame:  # noqa: ANN001
        return count(docs, "b").withColumn("t", zero).unionByName(count(target, "t").withColumn("b", zero))

    words = both(lambda rows, name: word_counts(rows, text_column, name))
    models = Models(cut(words.groupBy("word").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "words"))
    counted = both(lambda rows, name: _counted(rows, text_column, models.frequent, name))
    summed = counted.groupBy("code").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()  # at most WORDS^2 rows
    models.set_pairs(summed["code"].to_numpy(), [summed[name].to_numpy() for name in ("t", "b")])
    return models


_PACKED = "bucket int, base bigint, kind int, doc binary, word binary, other binary"


def _packed(docs: DataFrame, text_column: str, shared, buckets: int) -> DataFrame:  # noqa: ANN001
    """The bigrams with a rarer word by that word's bucket, as arrays; docs: `_row` (null for the target) and text.

    The words of a row are in order. kind 0: two rarer words, by the right one; 1: frequent and rarer; 2: rarer and frequent. `other` is the other word,
    or its place among the frequent ones; doc is the place from `base` on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value.frequent
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                batch = whole.slice(at, 10_000)
                rows = batch.column(0).to_pylist()
                base, found = rows[0], ([], [], [])
                for k, data in enumerate(utf8_arrays(batch.column(1))):
                    hashes, ids = pairs(data, frequent)
                    v, w, x, y = ids[:-1], ids[1:], hashes[:-1], hashes[1:]
                    place = k if base is None else rows[k] - base
                    for kind, (use, word, other) in enumerate((((v == 0) & (w == 0), y, x), ((v > 0) & (w == 0), y, v), ((v == 0) & (w > 0), x, w))):
                        if use.any():
                            key = word[use]
                            found[kind].append((np.full(len(key), place, np.uint16), key, other[use] if kind == 0 else other[use].astype(np.uint16)))
                for kind, parts in enumerate(found):
                    if not parts:
                        continue
                    doc, word, other = (np.concatenate(x) for x in zip(*parts))
                    bucket = (word % np.uint64(buckets)).astype(np.int64)
                    order = np.lexsort((word, bucket))  # equal words next to each other compress
                    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    out = []
                    for b in np.flatnonzero(np.diff(edge)).tolist():
                        own = order[edge[b] : edge[b + 1]]
                        out.append((b, base, kind, None if base is None else doc[own].tobytes(), word[own].tobytes(), other[own].tobytes()))
                    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["bucket", "base", "kind", "doc", "word", "other"])

    return docs.select("_row", text_column).transform(map_batches, run, _PACKED)


def bucket_losses(models: Models, base: list, kind: list, doc: list, word: list, other: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a bucket's packed arrays: the rows of documents, and each one's sums under the target and the background."""
    words = np.concatenate([np.frombuffer(x, np.uint64) for x in word])
    sizes = [len(x) // 8 for x in word]
    kinds = np.repeat(np.array(kind, np.uint8), sizes)
    others = np.concatenate([np.frombuffer(x, np.uint64 if k == 0 else np.uint16).astype(np.uint64) for x, k in zip(other, kind)])
    in_docs = np.repeat([b is not None for b in base], sizes)
    rows = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.uint16).astype(np.int64) + b for x, b in zip(doc, base) if b is not None)])
    _, pair = np.unique(mix64(mix64(words * _MORE + kinds) + others), return_inverse=True)
    _, own = np.unique(words, return_inverse=True)
    right = kinds < 2  # the word is on the right: each of its occurrences once
    ids, row = np.unique(rows, return_inverse=True)
    sums = []
    for k, counts in enumerate((~in_docs, in_docs)):
        c = np.bincount(pair, counts)[pair[in_docs]] * models.scale[k]
        n = np.bincount(own, counts & right)[own[in_docs]] * models.scale[k]
        r, frequent = right[in_docs], np.where(right, 0, others).astype(np.int64)[in_docs]
        smooth = np.where(r, MASS * (n + 1.0) / models.norm[k], models.smooth[k][frequent])
        sums.append(np.bincount(row, np.where(r, np.log(n + MASS), 0.0) - np.log(c + smooth), len(ids)))
    return ids, sums


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_tokens (words and the end), ce_target, ce_background, ce_difference (nats per token)."""
    target = cut(target.select(text_column), "target")
    models = fit(docs, target, text_column)
    shared = shared_value(docs.sparkSession, models)
    kind = docs.schema[id_column].dataType.simpleString()
    numbered = docs.select(F.col(id_column).alias("_id"), text_column).withColumn("_row", F.monotonically_increasing_id())

    def frequent_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for data in utf8_arrays(batch.column(2)):
                ids = pairs(data, m.frequent)[1]
                seen, codes = ids[1:][ids[1:] > 0], _frequent_codes(ids)
                out.append((max(len(ids) - 1, 0), *(float(c[seen].sum() - p[codes].sum(dtype=np.float64)) for c, p in zip(m.context, m.pair))))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.float64(), pa.float64())))], ["row", "id", "n", "t", "b"])

    def rarer_part(table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c in ("base", "kind", "doc", "word", "other")]
        ids, sums = bucket_losses(shared.value, *columns)
        return pa.table([pa.array(ids), *(pa.array(x) for x in sums)], ["row", "t", "b"])

    schema = f"row bigint, id {kind}, n bigint, t double, b double"
    whole = numbered.select("_row", "_id", text_column).transform(map_batches, frequent_part, schema)
    buckets = max(1, -(-sum(models.tokens) // BUCKET))
    packed = _packed(numbered, text_column, shared, buckets).unionByName(_packed(target.withColumn("_row", F.lit(None).cast("bigint")), text_column, shared, buckets))
    parts = packed.groupBy("bucket").applyInArrow(rarer_part, "row bigint, t double, b double")
    parts = parts.select("row", F.lit(None).cast(kind).alias("id"), F.lit(0).cast("bigint").alias("n"), "t", "b")
    sums = whole.unionByName(parts).groupBy("row").agg(F.max("id").alias("id"), F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    loss = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return sums.select(F.col("id").alias(id_column), F.col("n").alias("n_tokens"), loss("t").alias("ce_target"), loss("b").alias("ce_background"), (loss("t") - loss("b")).alias("ce_difference"))
