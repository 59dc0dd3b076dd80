"""Approximate nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; a cell is a pair of centroids. For a query the two lists
of half distances (minus the inner product with a centroid, so that their sum estimates minus the score) are sorted,
and a heap walks the pairs by summed distance until the cells seen hold a given share of all entries. The entries of
those cells are reranked with their whole vectors in double precision, summed in order of the components.

The share is measured, not set: on the bounded sample that the codebooks are fitted on, it is the least one whose
cells hold RECALL of the true neighbours of some of the sample's vectors. Vectors in clusters need a few hundredths,
vectors without structure a third or more.

Every vector is indexed. Cells are packed into blocks of bounded size (a cell that is larger is split over several
blocks by a hash of the id). Entries move once, to their block; queries go to the blocks that they visit and stream
past the block's entries there, so a task holds one block and one batch of queries, equal vectors in any number are
never in one task, and no pair of vectors leaves a task unless it is among the best of its block.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, neither as queries nor as candidates; rows that share an id are one entry, that of the smallest vector;
ties go to the smaller id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm._common import cut, map_batches

#: Vectors (those of the smallest id hashes) that the codebooks and the share are fitted on, and their components.
SAMPLE, COMPONENTS = 20_000, 4_000_000
#: A codebook has about sqrt(entries / PER_CELL) centroids, and so many at most.
PER_CELL, MOST_CENTROIDS = 8, 256
#: Share of the true neighbours that the visited cells hold, on the sample, and the sample's vectors asked about.
RECALL, ASKED = 0.96, 400
#: Entries of a block, queries that are scored at once.
BLOCK, CHUNK = 4096, 128


def codebook(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from the sample's first distinct vectors; a centroid without vectors stays where it is."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centroids = sample[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        own = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * (centroids * centroids).sum(1)).argmax(1)


def visited_cells(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, wanted: float) -> list[int]:
    """Cells by summed half distance, until they hold `wanted` entries; counts: entries by cell."""
    half = books[0].shape[1]
    left, right = -(books[0] @ query[:half]), -(books[1] @ query[half:])
    lo, ro = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    left, right, lo, ro = left[lo].tolist(), right[ro].tolist(), lo.tolist(), ro.tolist()
    width, out, held = len(ro), [], 0
    agenda, reached = [(left[0] + right[0], 0, 0)], [0] * (len(lo) + 1)
    while agenda and held < wanted:
        _, i, j = heapq.heappop(agenda)
        cell = lo[i] * width + ro[j]
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        reached[i] = j + 1
        # a pair enters once both its lower neighbours have been taken
        if j == 0 and i + 1 < len(lo):
            heapq.heappush(agenda, (left[i + 1] + right[0], i + 1, 0))
        if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(agenda, (left[i] + right[j + 1], i, j + 1))
        if j > 0 and i + 1 < len(lo) and reached[i + 1] == j:
            heapq.heappush(agenda, (left[i + 1] + right[j], i + 1, j))
    return out


def fitted_share(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], n: int, top: int) -> float:
    """The least share of the entries that holds RECALL of the neighbours: the `top` of n vectors are the first top * m / n
    of the sample's m. A neighbour is found once the cells up to its own by summed distance have been taken."""
    m, half = len(sample), books[0].shape[1]
    left, right = nearest(sample[:, :half], books[0]), nearest(sample[:, half:], books[1])
    first = int(max(1, min(m - 1, round(top * m / n))))
    if m < 3:
        return 1.0
    need = []
    for k in range(0, m, max(1, m // ASKED)):
        q = sample[k]
        cost = -(books[0] @ q[:half])[left] - (books[1] @ q[half:])[right]
        score = sample @ q
        score[k] = -np.inf
        found = np.argpartition(-score, first - 1)[:first]
        need.append(np.searchsorted(np.sort(cost), cost[found], side="right") / m)
    return float(min(1.0, np.quantile(np.concatenate(need), RECALL)))


class Block:
    """The entries of a block, with their cells."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        ids, x, cells = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.cells = ids[order], x[order], cells[order]
        self.first = int(cells.min())
        self.span = int(cells.max()) - self.first + 1
        self.longest = float(np.sqrt((self.x * self.x).sum(1).max()))

    def best(self, own: np.ndarray, q: np.ndarray, cells: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, entry ids and scores: each query's `top` entries among the cells that it visits.

        A matrix product finds them but for its rounding; what may be among them is summed component by component.
        """
        rough = q @ self.x.T
        slack = 1e-12 * q.shape[1] * self.longest * np.sqrt((q * q).sum(1))
        rows, places = [], []
        for r, (me, visited) in enumerate(zip(own, cells)):
            seen = np.zeros(self.span, bool)
            seen[visited[(visited >= self.first) & (visited < self.first + self.span)] - self.first] = True
            open_ = np.flatnonzero(seen[self.cells - self.first] & (self.ids != me))
            if len(open_) > top:
                s = rough[r, open_]
                open_ = open_[s >= np.partition(s, len(s) - top)[len(s) - top] - slack[r]]
            rows.append(np.full(len(open_), r))
            places.append(open_)
        row, place = np.concatenate(rows), np.concatenate(places)
        score = np.zeros(len(row))
        for d in range(q.shape[1]):
            score += q[row, d] * self.x[place, d]
        order = np.lexsort((self.ids[place], -score, row))
        row, place, score = row[order], place[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < top
        return own[row[keep]], self.ids[place[keep]], score[keep]


def _lists(column: pa.Array, kind: type) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:z].astype(kind, copy=False) for a, z in zip(offsets, offsets[1:])]


def usable(vector: Column | str) -> Column:
    """Whether a vector takes part: not null, not zero, all components there and finite."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda v: v != 0), F.lit(False))


def neighbours(vectors: DataFrame, is_query: Column, top: int = 20, share: float | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per query and rank (from 1): query_id, rank, vec_id, score. is_query: over the id column named `id`. share: of the
    entries that a query visits, measured where it isn't given."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")).where(F.col("id").isNotNull())
    rows = rows.where(usable("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = cut(rows, "vectors")
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows, half = rows.where(F.size("vector") == d), (d + 1) // 2
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, COMPONENTS // d))).select("vector").toPandas()
    sample = np.array(sample["vector"].tolist(), np.float64)
    k = int(min(MOST_CENTROIDS, max(2, np.ceil(np.sqrt(n / PER_CELL)))))
    books = codebook(sample[:, :half], k), codebook(sample[:, half:], k)
    width = len(books[1])
    wanted = max((fitted_share(sample, books, n, top) if share is None else share) * n, top + 1)  # a query's own entry counts too

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.array(batch["vector"].tolist(), np.float64)
                batch["cell"] = (nearest(x[:, :half], books[0]) * width + nearest(x[:, half:], books[1])).astype(np.int32)
                yield batch

    index = cut(rows.mapInPandas(assign, "id long, vector array<double>, cell int"), "index")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in index.groupBy("cell").count().collect():  # as many rows as cells, a bounded number
        counts[r["cell"]] = r["count"]

    # cells in order fill blocks of at most BLOCK entries; a larger cell has blocks of its own
    first, pieces, block, held = np.zeros_like(counts), np.ones_like(counts), 0, 0
    for cell, c in enumerate(counts.tolist()):
        if c > BLOCK:
            block += held > 0
            pieces[cell] = -(-c * 5 // (4 * BLOCK))
            first[cell], held = block, 0
            block += int(pieces[cell])
        else:
            if held + c > BLOCK:
                block, held = block + 1, 0
            first[cell], held = block, held + c
    places = F.broadcast(spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(counts), dtype=np.int32), "first": first, "pieces": pieces})))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                out = []
                for me, vector in zip(batch["id"][at : at + CHUNK], batch["vector"][at : at + CHUNK]):
                    by_block: dict[int, list[int]] = {}
                    for cell in visited_cells(np.asarray(vector, np.float64), books, counts, wanted):
                        for b in range(int(first[cell]), int(first[cell] + pieces[cell])):
                            by_block.setdefault(b, []).append(cell)
                    out += [(b, me, vector, cells) for b, cells in by_block.items()]
                yield pd.DataFrame(out, columns=["block", "id", "vector", "cells"])

    visits = index.where(is_query).select("id", "vector").mapInPandas(walk, "block long, id long, vector array<double>, cells array<int>")
    placed = index.join(places, "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("pieces")))
    entries = placed.select("block", F.lit(0).alias("kind"), "id", "vector", F.array("cell").alias("cells"))
    met = entries.unionByName(visits.select("block", F.lit(1).alias("kind"), "id", "vector", "cells"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for batch in batches:
            blocks, kinds, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            edges = np.flatnonzero(np.diff(blocks * 2 + kinds, prepend=-1))
            vectors, cells = np.array(_lists(batch.column(3), np.float64)), _lists(batch.column(4), np.int64)
            for a, z in zip(edges, [*edges[1:], len(blocks)]):
                if blocks[a] != now:
                    now, parts, held = blocks[a], [], None
                if kinds[a] == 0:
                    parts.append((ids[a:z], vectors[a:z], np.concatenate(cells[a:z])))
                    continue
                if not parts:
                    continue
                held = held or Block(parts)
                for at in range(a, z, CHUNK):
                    upto = min(z, at + CHUNK)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.best(ids[at:upto], vectors[at:upto], cells[at:upto], top)], ["query_id", "vec_id", "score"])

    best = met.repartition("block").sortWithinPartitions("block", "kind").transform(map_batches, search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
