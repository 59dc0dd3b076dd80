"""Document quality from overlapping heuristics: a weak-label model and a hashed linear scorer.

Six labellers know one kind of junk each and vote bad (-1) or abstain (0) on a document, from shares of its bytes, words
and lines; two vote good (1) on signs of prose, one of them bad on poor vocabulary. Their votes make one of 3^8
patterns; the patterns are counted over all documents, and expectation-maximisation on the counts estimates, for a good
and a bad document each, how often every labeller casts each vote. The pattern's posterior is the weak label. A
logistic scorer over hashed features (words, triples of character classes, binned shares) is trained on the posteriors
of a bounded sample of distinct texts and scores every document; documents below one half go.

Defined cases: a null or empty text, or one without words, has score 0 and goes; texts of any length are read whole;
repeated rows are counted and scored each and count once in the sample, which doesn't look at ids; where the sample
is empty the posterior's side decides; an empty table gives an empty result; other columns pass by untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import map_batches, mix64, shared_value, utf8_arrays, word_hashes

LABELLERS = ("symbols", "capitals", "repeats", "exclamations", "bare_marks", "equal_lines", "prose", "variety")
#: Distinct texts (about; those of the smallest hashes) that the scorer is trained on, and its hashed features.
SAMPLE, FEATURES = 4_000, 1 << 15
#: From these shares on, the first six vote bad; up to the second bounds, all six at once, a text can be prose.
BAD = np.array([0.2, 0.4, 0.25, 0.2, 0.2, 0.75])
PROSE = np.array([0.1, 0.2, 0.1, 0.1, 0.12, 0.6])
#: Words to a sentence of prose at most; distinct words by the root of all: poor below the first, rich from the second.
SENTENCE, VARIETY = 60.0, (1.5, 3.0)


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _MARK, _STOP = _bytes("*%$#&@~^=|<>{}[]_/\\+"), _bytes("!"), _bytes(".!?")
_UPPER, _LETTER, _WORDY = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = True
_WORDY[:128] = [chr(c).isalnum() for c in range(128)]
#: Classes of bytes for the triples: lower case, upper case, digit, space, line end, stop, comma, mark, symbol, quote or bracket, other.
_CLASS = np.full(256, 10, np.int64)
for _n, _m in enumerate((np.r_[97:123, 128:256], np.r_[65:91], np.r_[48:58], [32, 9], [10, 13], [46, 63], [44, 59, 58], [33], np.flatnonzero(_SYMBOL), [34, 39, 40, 41])):
    _CLASS[_m] = _n


def shares(data: np.ndarray, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What the labellers look at: six shares of junk, words to a sentence, variety."""
    n = len(words)
    inside = lambda mask: np.concatenate(([0], np.cumsum(mask[data])))
    per_word = lambda mask: (c := inside(mask))[ends] - c[starts]
    letters = int(_LETTER[data].sum())
    lines = [x for x in data.tobytes().split(b"\n") if x.strip()]
    return np.array(
        [
            (per_word(_SYMBOL) >= 2).mean(),
            (int(_UPPER[data].sum()) - int(_UPPER[data[starts]].sum())) / max(letters, 1),  # without first letters
            (words[1:] == words[:-1]).sum() / max(n - 1, 1),
            (per_word(_MARK) >= 2).mean(),
            (per_word(_WORDY) == 0).mean(),
            1 - len(set(lines)) / max(len(lines), 1),
            n / max(1, int(_STOP[data[ends - 1]].sum())),
            len(np.unique(words)) / np.sqrt(n),
        ]
    )


def votes(s: np.ndarray, n_words: int) -> np.ndarray:
    """1 good, -1 bad, 0 abstains; short texts leave some labellers without a vote."""
    out = np.zeros(len(LABELLERS), np.int64)
    out[:6] = np.where(s[:6] >= BAD, -1, 0)
    out[6] = bool((s[:6] <= PROSE).all() and s[6] <= SENTENCE)
    if n_words < 8:
        out[2] = out[5] = 0
    if n_words >= 40:
        out[7] = -1 if s[7] < VARIETY[0] else int(s[7] >= VARIETY[1])
    return out


def features(data: np.ndarray, words: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (slot, value): words, triples of classes and binned shares; each kind has length one."""
    slot = lambda codes: (mix64(np.asarray(codes).astype(np.uint64)) >> np.uint64(32)) % np.uint64(FEATURES)
    c = _CLASS[data]
    triples = np.bincount(c[:-2] * 121 + c[1:-1] * 11 + c[2:], minlength=1331) if len(c) > 2 else np.zeros(1331, np.int64)
    seen = np.flatnonzero(triples)
    kinds, n_words = [], np.unique(words, return_counts=True)
    for key, count in ((n_words[0] ^ np.uint64(0xA5A5), n_words[1]), (seen + 1_000_003, triples[seen])):
        v = np.log1p(count)
        kinds.append((slot(key), v / max(np.sqrt((v * v).sum()), 1e-9)))
    bins = np.minimum((np.log1p(20 * np.maximum(s, 0)) * 4).astype(np.int64), 63) + 64 * np.arange(len(s)) + 7_000_003
    kinds.append((slot(bins), np.full(len(s), 1 / np.sqrt(len(s)))))
    return np.concatenate([k for k, _ in kinds]).astype(np.int64), np.concatenate([v for _, v in kinds])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Of the votes (rows of -1, 0, 1) and their counts: the posterior of good by pattern, the prior, and
    rates[y, labeller, vote + 1], the shares of each vote among bad (0) and good (1) documents."""
    good = 1 / (1 + np.exp(-2.0 * patterns.sum(1)))  # from the majority
    total, one_hot = counts.sum(), np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        before = good
        prior = float(np.clip((good * counts).sum() / total, 1e-6, 1 - 1e-6))
        rates = np.empty((2, patterns.shape[1], 3))
        for y, p in ((0, 1 - good), (1, good)):
            weight = p * counts
            rates[y] = ((weight[:, None, None] * one_hot).sum(0) + 0.1) / (weight.sum() + 0.3)
        like = [(one_hot * np.log(rates[y])).sum((1, 2)) + np.log(prior if y else 1 - prior) for y in (0, 1)]
        good = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(good - before).max() < 1e-9:
            break
    return good, prior, rates


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, size: int, rounds: int = 120, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam; targets are probabilities."""
    if not rows:
        return np.zeros(size), 0.0
    at = np.concatenate([k for k, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(k) for k, _ in rows])
    w, b, m, v, n = np.zeros(size), 0.0, np.zeros(size + 1), np.zeros(size + 1), len(rows)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[at], n) + b
        e = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - targets
        g = np.append(np.bincount(at, value * e[row], size) / n + ridge * w, e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class QualityModel:
    """The weak-label model's posterior by pattern, and the linear scorer."""

    def __init__(self, posterior: dict[int, float], prior: float, weights: np.ndarray, intercept: float) -> None:
        self.posterior, self.prior, self.weights, self.intercept = posterior, prior, weights, intercept
        self.trained = bool(weights.any()) or intercept != 0.0

    def score(self, data: np.ndarray) -> tuple[int, float | None, float]:
        """Pattern, posterior and score of a text's bytes; without words -1, null and 0."""
        words, starts, ends = word_hashes(data)
        if not len(words):
            return -1, None, 0.0
        s = shares(data, words, starts, ends)
        pattern = encode(votes(s, len(words)))
        at, value = features(data, words, s)
        posterior = self.posterior.get(pattern, self.prior)
        if not self.trained:
            return pattern, posterior, posterior
        z = float((self.weights[at] * value).sum() + self.intercept)
        return pattern, posterior, float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def encode(v: np.ndarray) -> int:
    return int(((v + 1) * 3 ** np.arange(len(v))).sum())


def decode(pattern: int) -> np.ndarray:
    return pattern // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def fit(docs: DataFrame, text_column: str = "text") -> QualityModel:
    """Counts the patterns over all documents, runs EM on them, and trains the scorer on a bounded sample."""

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, int] = {}
            for data in utf8_arrays(batch.column(0)):
                words, starts, ends = word_hashes(data)
                if len(words):
                    p = encode(votes(shares(data, words, starts, ends), len(words)))
                    found[p] = found.get(p, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), pa.array(found.values(), pa.int64())], ["pattern", "n"])

    counted = docs.select(text_column).transform(map_batches, patterns, "pattern int, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not counted:
        return QualityModel({}, 0.5, np.zeros(FEATURES), 0.0)
    counts = np.array([r["n"] for r in counted], float)
    good, prior, _ = expectation_maximisation(np.array([decode(r["pattern"]) for r in counted]), counts)
    posterior = {r["pattern"]: float(g) for r, g in zip(counted, good)}

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in utf8_arrays(batch.column(0)):
                words, starts, ends = word_hashes(data)
                if len(words):
                    s = shares(data, words, starts, ends)
                    at, value = features(data, words, s)
                    out.append((encode(votes(s, len(words))), at.astype(np.int32).tobytes(), value.astype(np.float32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], ["pattern", "at", "value"])

    # a text's hash decides, so that equal texts, however many, leave one row
    share = min(1.0, SAMPLE / counts.sum())
    chosen = docs.where(F.pmod(F.xxhash64(F.lit(11), text_column), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = chosen.select(text_column).transform(map_batches, sampled, "pattern int, at binary, value binary").distinct().collect()
    rows.sort(key=lambda r: (r["pattern"], bytes(r["at"]), bytes(r["value"])))
    x = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float)) for r in rows]
    weights, intercept = fit_logistic(x, np.array([posterior[r["pattern"]] for r in rows]), FEATURES)
    return QualityModel(posterior, prior, weights, intercept)


def score_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: QualityModel | None = None) -> DataFrame:
    """Per row: id, votes (array in the order of LABELLERS, null without words), posterior, score, kept."""
    shared = shared_value(docs.sparkSession, model or fit(docs, text_column))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.score(data) for data in utf8_arrays(batch.column(1))]
            cast = [None if p < 0 else decode(p) for p, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cast, pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[2] >= 0.5 for x in found], pa.bool_())],
                [id_column, "votes", "posterior", "score", "kept"],
            )

    return docs.select(id_column, text_column).transform(map_batches, run, f"{id_column} {kind}, votes array<int>, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents that the scorer keeps, with all their columns; nothing is shuffled."""
    shared = shared_value(docs.sparkSession, fit(docs, text_column))
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(data)[2] >= 0.5 for data in utf8_arrays(batch.column(place))], pa.bool_()))

    return docs.transform(map_batches, run, docs.schema)
