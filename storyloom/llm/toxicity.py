"""Severity of toxic language by cumulative-link ordinal regression over sparse word features.

The labels say whether a document is toxic, not how much, so the grades 1 to 3 of toxic documents are a proxy: half of
the sample trains a binary logistic scorer over the features and scores the other half, each way round, and a toxic
document's grade is the third that its out-of-fold score falls into; grade 0 are the others. No grade is counted from
a document's own words, but grades and regression look at the same kind of features. On sf0.1, two models of disjoint
labels give 0.67 of the toxic documents of the rest the same grade and 0.98 the same or a neighbouring one, and their
severities have a rank correlation of 0.92 there (see the tests).

The regression has one weight vector for all thresholds: P(grade > k) = logistic(w.x - t_k) with t_0 < t_1 < t_2.
Expected severity is the sum of the three probabilities, and a document is toxic if P(grade > 0) is one half or more.
Every document, with features or without, has the model's probabilities.

Features are log counts of the words that the labelled sample ties most to the label (chi-square). Words are known by
64-bit hashes, so no clean word shares a feature with a toxic one. The sample is bounded; its word statistics are
counted by Spark; every document is scored on its whole text in one narrow pass.

Defined cases: a null or empty text has no features, and so the probabilities of the thresholds alone; documents
without a label are scored like others; labels that are null, or that contradict each other for an id, are left out;
repeated rows are scored each; without toxic or without clean labels every severity is 0; other columns pass by
untouched; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import PLAIN, cut, map_batches, shared_value, word_hashes
from storyloom.llm.quality import fit_logistic

#: Labelled documents (about; those of the smallest id hashes) that the model is fitted on, and its words.
SAMPLE, WORDS = 10_000, 1_000
#: Least chi-square of a feature (one degree of freedom, p = 0.001) and least odds ratio, either way.
LEAST_CHI, LEAST_ODDS = 10.83, 3.0
#: A feature occurs in this share of the sample's toxic documents at least.
LEAST_SHARE = 0.004
GRADES = 3


def plain(text: str | None) -> np.ndarray:
    return word_hashes(np.frombuffer((text or "").lower().encode("utf-8"), np.uint8), PLAIN)[0]


class SeverityModel:
    """Sorted word hashes with shared weights, and the ordered thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.words, self.weights, self.thresholds = words, weights, thresholds

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The features of a text: places and log counts."""
        found = plain(text)
        if not len(found) or not len(self.words):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
        at, n = np.unique(at[self.words[at] == found], return_counts=True)
        return at, np.log1p(n)

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2."""
        at, x = self.counts(text)
        z = (self.weights[at] * x).sum() - self.thresholds
        return np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, size: int, rounds: int = 600, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model by full-batch Adam on the likelihood.

    The thresholds are t_0 and positive steps, kept positive as exponentials.
    """
    at = np.concatenate([k for k, _ in rows]).astype(np.int64)
    value = np.concatenate([v for _, v in rows]).astype(float)
    row, n = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows]), len(rows)
    w, free = np.zeros(size), np.concatenate(([2.0], np.zeros(GRADES - 1)))
    m, v = np.zeros(size + GRADES), np.zeros(size + GRADES)
    index = np.arange(n)
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))
        z = np.bincount(row, value * w[at], n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -30, 30)))
        upper = np.concatenate((np.ones((n, 1)), p), 1)[index, grades]  # P(grade > g - 1)
        lower = np.concatenate((p, np.zeros((n, 1))), 1)[index, grades]  # P(grade > g)
        inverse = 1 / np.maximum(upper - lower, 1e-9)
        slope_up, slope_low = upper * (1 - upper), lower * (1 - lower)
        gz = -(slope_up - slope_low) * inverse / n
        g_cut = np.zeros(GRADES)
        np.add.at(g_cut, np.maximum(grades - 1, 0), np.where(grades > 0, slope_up * inverse, 0) / n)
        np.add.at(g_cut, np.minimum(grades, GRADES - 1), np.where(grades < GRADES, -slope_low * inverse, 0) / n)
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate((np.bincount(at, value * gz[row], size) + ridge * w, tail[:1], tail[1:] * np.exp(free[1:])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, free = w - step[:size], free - step[size:]
    return w, np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> SeverityModel:
    """Fits on a bounded sample of labelled documents (a broadcast of at most about SAMPLE ids)."""
    none = SeverityModel(np.empty(0, np.uint64), np.empty(0), np.full(GRADES, np.inf))
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    n = known.count()
    if not n:
        return none
    share = min(1.0, SAMPLE / n)
    chosen = known.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(chosen), "id")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, words, counts = [], [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w, c = np.unique(plain(text.as_py()), return_counts=True)
                ys.append(y)
                words.append(w.view(np.int64))
                counts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], ["y", "words", "counts"])

    sample = cut(texts.select("y", "text").transform(map_batches, distinct_words, "y int, words array<bigint>, counts array<int>"), "toxic-sample")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sum(v for k, v in size.items() if k > 0), size.get(0, 0)
    if not toxic or not clean:
        return none
    df = sample.select((F.col("y") > 0).alias("t"), F.explode("words").alias("word")).groupBy("word").agg(F.count_if("t").alias("a"), F.count_if(~F.col("t")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    all_ = float(toxic + clean)
    spread = (a * (clean - b) - b * (toxic - a)) ** 2 * all_ / ((a + b) * (all_ - a - b + 1e-9) * toxic * clean)
    odds = ((a + 0.5) / (toxic - a + 0.5)) / ((b + 0.5) / (clean - b + 0.5))
    tied = df.where(a >= LEAST_SHARE * toxic).select("word", spread.alias("chi"), odds.alias("odds"))
    tied = tied.where((F.col("chi") >= LEAST_CHI) & ((F.col("odds") >= LEAST_ODDS) | (F.col("odds") <= 1 / LEAST_ODDS)))
    top = [r["word"] for r in tied.orderBy(F.desc("chi"), "word").limit(WORDS).collect()]
    words = np.sort(np.array(top, np.int64).view(np.uint64))
    chosen_words = F.array(*[F.lit(w) for w in top]).cast("array<bigint>")
    kept = F.filter(F.arrays_zip("words", "counts"), lambda x: F.array_contains(chosen_words, x["words"]))
    rows = sample.select("y", kept.alias("kept")).collect()  # a bounded sample, of each row at most WORDS pairs
    place = {int(w): k for k, w in enumerate(words.view(np.int64))}
    x = []
    for r in rows:
        pairs = sorted((place[k["words"]], k["counts"]) for k in r["kept"])
        x.append((r["y"] > 0, np.array([k for k, _ in pairs], np.int64), np.log1p(np.array([c for _, c in pairs], float))))
    x.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    features, is_toxic = [(k, v) for _, k, v in x], np.array([y for y, _, _ in x])
    weights, thresholds = fit_ordinal(features, proxy_grades(features, is_toxic, len(words)), len(words))
    return SeverityModel(words, weights, thresholds)


def proxy_grades(rows: list[tuple[np.ndarray, np.ndarray]], is_toxic: np.ndarray, size: int) -> np.ndarray:
    """0 for documents that aren't toxic; for the others, 1 to 3 by the third of their out-of-fold scores. Even and odd
    rows are the folds; equal scores share a grade."""
    score = np.zeros(len(rows))
    for fold in (0, 1):
        theirs = list(range(1 - fold, len(rows), 2))
        w, b = fit_logistic([rows[k] for k in theirs], is_toxic[theirs].astype(float), size)
        for k in range(fold, len(rows), 2):
            score[k] = (w[rows[k][0]] * rows[k][1]).sum() + b
    thirds = np.quantile(score[is_toxic], [1 / 3, 2 / 3])
    return np.where(is_toxic, 1 + (score > thirds[0]).astype(int) + (score > thirds[1]), 0)


def severity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, severity (expected grade), grade (the most thresholds passed with one half), toxic."""
    shared = shared_value(docs.sparkSession, fit(docs, labels, id_column, text_column))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [shared.value.above(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([float(x.sum()) for x in p], pa.float64()), pa.array([int((x >= 0.5).sum()) for x in p], pa.int32()), pa.array([bool(x[0] >= 0.5) for x in p], pa.bool_())],
                [id_column, "severity", "grade", "toxic"],
            )

    return docs.select(id_column, text_column).transform(map_batches, run, f"{id_column} {kind}, severity double, grade int, toxic boolean")


def keep_clean(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that aren't toxic, with all their columns; nothing is shuffled."""
    shared = shared_value(docs.sparkSession, fit(docs, labels, id_column, text_column))
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.above(t.as_py())[0] < 0.5 for t in batch.column(place)], pa.bool_()))

    return docs.transform(map_batches, run, docs.schema)
