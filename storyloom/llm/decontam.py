"""Benchmark decontamination: training passages are queries against a BM25 inverted index of the test items.

The index holds, by term, the items in blocks of neighbouring ids with the largest weight of each block. A weight is
the term's BM25 part in the item divided by the score that the whole item would get, so that a passage's score is the
share of the item that it covers and one threshold serves all items. Items are dealt to classes by length, and a
document is cut into passages of twice the class's longest item at half that stride, so that every occurrence of an
item lies in one passage and one long item stretches the passages of its own class alone. A passage is dropped if the sum of its terms' maxima is below the threshold, then block by block if the sum of the block maxima
is; in the blocks left, cursors over the postings move by block-max WAND. All items at or above the threshold are
retrieved, and verified: question and answer must both share enough of their word trigrams with the passage. The
answer is an item's last sentence, or its last third where there is but one sentence.

Document frequencies and the mean length are counted by Spark over the whole test set. The set is cut into index
blocks of bounded size (ITEMS, WORDS); the driver and the workers hold one block at a time, and its hits are written
before the next is built where there are several. Documents are read in one narrow pass for each block; none is moved.

Defined cases: null or empty texts have no hits; items without words match nothing; items of fewer than three words in
question or answer are verified by whole words; rows that share an id give hits each, and so do repeated items; an item
without an id is looked for like any other and gives hits with a null item_id; ties in score are all retrieved; empty
tables give empty results; other columns are not looked at, or kept by without_hits().
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from storyloom.llm._common import PLAIN, cut, map_batches, mix64, scope, shared_value, word_hashes

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of the trigrams of question and of answer.
THRESHOLD, OVERLAP = 0.5, 0.5
#: Items of an index block (a bounded broadcast) and their words, about; neighbouring items that share a block maximum.
ITEMS, WORDS, NEIGHBOURS = 20_000, 1_000_000, 4
#: Words of a passage's stride in the class of the shortest items; each next class has twice as many.
STRIDE = 64


def plain_words(text: str | None) -> np.ndarray:
    """The hashes of a text's words: lower case, ASCII punctuation left out."""
    return word_hashes(np.frombuffer((text or "").lower().encode("utf-8"), np.uint8), PLAIN)[0]


def question_and_answer(text: str | None) -> tuple[str, str]:
    """The last sentence is the answer; of one sentence, the last third of its words."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if re.search(r"\w", s)]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = (text or "").split()
    at = len(words) - max(1, len(words) // 3)
    return " ".join(words[:at]), " ".join(words[at:])


def grams(words: np.ndarray, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    h = words[: len(words) - n + 1]
    for i in range(1, n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return np.unique(h)


class ItemIndex:
    """The postings of one block of test items, of `longest` words at most."""

    def __init__(self, items: list[tuple], n_all: int, mean_words: float, df: dict[int, int], longest: int) -> None:
        self.ids = [i for i, _ in items]
        self.stride = max(STRIDE, longest)
        self.parts = []
        triples: list[tuple[int, int, float]] = []
        for row, (_, text) in enumerate(items):
            words = plain_words(text)
            terms, tf = np.unique(words, return_counts=True)
            idf = np.log1p([(n_all - df[int(t)] + 0.5) / (df[int(t)] + 0.5) for t in terms]) if len(terms) else np.empty(0)
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words)) if len(terms) else np.empty(0)
            triples += [(int(t), row, float(x)) for t, x in zip(terms, w / w.sum() if len(w) else w)]
            halves = []
            for half in question_and_answer(text):
                x = plain_words(half)
                halves.append((grams(x), 3) if len(x) >= 3 else (np.unique(x), 1))
            self.parts.append(halves)
        triples.sort()
        terms = np.array([t[0] for t in triples], np.uint64)
        self.terms, first = np.unique(terms, return_index=True)
        self.rows = np.array([t[1] for t in triples], np.int64)
        self.weights = np.array([t[2] for t in triples])
        self.start = np.append(first, len(triples)).astype(np.int64)
        self.max = np.maximum.reduceat(self.weights, first) if len(triples) else np.empty(0)
        # block maxima, by term and block
        code = np.repeat(np.arange(len(self.terms)), np.diff(self.start)) * (len(items) // NEIGHBOURS + 1) + self.rows // NEIGHBOURS
        edge = np.flatnonzero(np.diff(code, prepend=-1))
        self.block = (self.rows // NEIGHBOURS)[edge] if len(edge) else np.empty(0, np.int64)
        self.block_max = np.maximum.reduceat(self.weights, edge) if len(edge) else np.empty(0)
        self.block_start = np.searchsorted(edge, self.start)
        self.row_list, self.weight_list, self.start_list = self.rows.tolist(), self.weights.tolist(), self.start.tolist()
        self.n_blocks = len(items) // NEIGHBOURS + 1

    def term_ids(self, words: np.ndarray) -> np.ndarray:
        """Of each word its term, or -1."""
        if not len(self.terms):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Rows of all items that score at least the threshold for the distinct terms, with their scores."""
        slack = threshold - 1e-9
        if self.max[terms].sum() < slack:
            return []
        lo, hi = self.block_start[terms], self.block_start[terms + 1]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(int((hi - lo).sum()))
        bounds = np.bincount(self.block[at], self.block_max[at], self.n_blocks)
        out = []
        for block in np.flatnonzero(bounds >= slack).tolist():
            out += self._wand(terms, block * NEIGHBOURS, (block + 1) * NEIGHBOURS, slack)
        return out

    def _wand(self, terms: np.ndarray, first: int, last: int, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND over the rows from first to before last."""
        cursors = []
        rows, weights, start = self.row_list, self.weight_list, self.start_list
        for t in terms.tolist():
            a = bisect_left(rows, first, start[t], start[t + 1])
            z = bisect_left(rows, last, a, start[t + 1])
            if a < z:
                cursors.append([rows[a:z], own := weights[a:z], 0, max(own)])
        out = []
        while True:
            cursors = sorted((c for c in cursors if c[2] < len(c[0])), key=lambda c: c[0][c[2]])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= threshold:
                    pivot = c[0][c[2]]
                    break
            if pivot is None:
                return out
            if cursors[0][0][cursors[0][2]] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0][c[2]] == pivot:
                        score += c[1][c[2]]
                        c[2] += 1
                if score >= threshold:
                    out.append((pivot, score))
            else:
                for c in cursors:
                    while c[2] < len(c[0]) and c[0][c[2]] < pivot:
                        c[2] += 1

    def verify(self, row: int, words: np.ndarray, cache: dict[int, np.ndarray]) -> tuple[float, float]:
        """The shares of the question's and of the answer's n-grams that the passage has; 1 for a part without words."""
        shares = []
        for part, n in self.parts[row]:
            if n not in cache:
                cache[n] = grams(words, n)
            shares.append(float(np.isin(part, cache[n], assume_unique=True).mean()) if len(part) else 1.0)
        return shares[0], shares[1]

    def hits(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float, float, int]]:
        """Of a document: item row, score, question and answer overlap, word at which the passage begins; the best passage of each item."""
        words = plain_words(text)
        if not len(words) or not len(self.terms):
            return []
        terms, stride, best = self.term_ids(words), self.stride, {}
        for at in range(0, max(1, len(words) - stride), stride):
            own = np.unique(terms[at : at + 2 * stride])
            own = own[1:] if len(own) and own[0] < 0 else own
            found = self.retrieve(own, threshold) if len(own) else []
            cache: dict[int, np.ndarray] = {}
            for row, score in found:
                q, a = self.verify(row, words[at : at + 2 * stride], cache)
                if q >= overlap and a >= overlap and (row not in best or (q + a, score) > best[row][:2]):
                    best[row] = (q + a, score, q, a, at)
        return [(row, *best[row][1:]) for row in sorted(best)]


class TestItems:
    """The test set with its statistics, as index blocks that are built one after another."""

    def __init__(self, benchmark: DataFrame, id_column: str, text_column: str) -> None:
        self.kind = benchmark.schema[id_column].dataType

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [plain_words(t.as_py()) for t in batch.column(1)]
                stride = [STRIDE << max(0, (len(w) - 1) // STRIDE).bit_length() for w in words]
                columns = [pa.array([len(w) for w in words], pa.int64()), pa.array(stride, pa.int64()), pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["item", "text", "n", "stride", "words"])

        items = benchmark.select(F.col(id_column).alias("item"), F.col(text_column).alias("text"))
        self.items = cut(items.transform(map_batches, counted, f"item {self.kind.simpleString()}, text string, n bigint, stride bigint, words array<bigint>"), "items")
        sizes = self.items.groupBy("stride").agg(F.count("*").alias("items"), F.sum("n").alias("words")).orderBy("stride").collect()  # a row for each class
        self.n, words = sum(r["items"] for r in sizes), sum(r["words"] for r in sizes)
        self.mean = words / max(self.n, 1) or 1.0
        self.df = cut(self.items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")), "item-words")
        pieces = [(r["stride"], max(-(-r["items"] // ITEMS), -(-r["words"] // WORDS))) for r in sizes if r["words"]]
        #: Class, block and number of blocks of each block; several blocks of a class are dealt with a margin.
        self.blocks = [(stride, b, n) for stride, k in pieces for n in [k if k == 1 else -(-k * 5 // 4)] for b in range(n)]

    def index(self, stride: int, b: int, n: int) -> ItemIndex:
        own = self.items.where((F.col("stride") == stride) & (F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b))
        rows = own.select("item", "text").orderBy("item", "text").collect()
        df = own.select(F.explode("words").alias("word")).distinct().join(self.df, "word").collect()
        return ItemIndex([tuple(r) for r in rows], self.n, self.mean, {r["word"] & ((1 << 64) - 1): r["df"] for r in df}, stride)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """One row per document and test item found in it: id, item_id, score, question_overlap, answer_overlap, word_offset."""
    items = TestItems(benchmark, item_column, text_column)
    kind, item_type = docs.schema[id_column].dataType.simpleString(), to_arrow_type(items.kind)
    schema = f"{id_column} {kind}, item_id {items.kind.simpleString()}, score double, question_overlap double, answer_overlap double, word_offset bigint"

    def found_in(block: tuple[int, int, int]) -> DataFrame:
        shared = shared_value(docs.sparkSession, items.index(*block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = [(k, index.ids[h[0]], *h[1:]) for k, t in enumerate(batch.column(1)) for h in index.hits(t.as_py(), threshold, overlap)]
                if found:
                    at, *columns = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, (item_type, pa.float64(), pa.float64(), pa.float64(), pa.int64())))],
                        [id_column, "item_id", "score", "question_overlap", "answer_overlap", "word_offset"],
                    )

        return docs.select(id_column, text_column).transform(map_batches, run, schema)

    if len(items.blocks) == 1:
        return found_in(items.blocks[0])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in items.blocks:
        with scope() as own:
            out = out.unionByName(own.finish(found_in(block), "hits"))
    return out


def without_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """The documents in which no test item is found, with all their columns."""
    items = TestItems(benchmark, item_column, text_column)
    place = docs.columns.index(text_column)

    def clean(docs: DataFrame, block: tuple[int, int, int]) -> DataFrame:
        shared = shared_value(docs.sparkSession, items.index(*block))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.hits(t.as_py(), threshold, overlap) for t in batch.column(place)], pa.bool_()))

        return docs.transform(map_batches, run, docs.schema)

    for block in items.blocks[:-1]:
        with scope() as own:
            docs = own.finish(clean(docs, block), "clean")
    return clean(docs, items.blocks[-1]) if items.blocks else docs
