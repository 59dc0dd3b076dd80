"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

A document's set is its distinct k-word shingles (A-Z in lower case, words split at ASCII white space). One hash
per shingle fills all bins of the signature: the leading bits choose the bin, the smallest hash stays. Empty bins
are densified by borrowing from a full bin that a fixed random order of the bins, one for each empty bin, names
first. Bands of bins make bucket keys.

Documents with equal sets are one class, dealt with by its smallest id. In each bucket every class is compared with
the bucket's smallest id alone: a star has as many edges as members. Candidates are confirmed on their full sets.
A star can miss a link between two of its leaves, so the buckets that still hold several components are compared
exhaustively, in blocks of bounded members and shingles within a task: the intersections of a block's sets are one
matrix product, and only links that join components leave the task. A bucket's largest component, which the star has
found, meets the others but not itself, so that copies of a text grow with what is left open, not with the bucket. No
pair that shares a bucket is left out, and pairs are never rows of a table except in stars. Buckets with the same
members are compared once. Bands and texts move for one document of each class, rows of copies as ids and hashes.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text of
fewer than k words has its whole sequence as one shingle; rows that share an id are one document with all their
sets; a row without an id takes the component of its equals, null if they have no id either, and is kept only in
that case; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import cut, map_batches, mix64, scope, shingle_hashes, utf8_arrays, word_hashes
from storyloom.llm.graphs import components

#: Rows (bins) of a band and bands: a pair at similarity 0.8 is missed with probability (1 - 0.8^4)^36 < 1e-8.
ROWS, BANDS = 4, 36
#: Members of a block and their shingles, about; two blocks are compared at once.
BLOCK, BLOCK_SHINGLES = 400, 200_000


def _borrowing_order(bins: int) -> np.ndarray:
    """Of each bin, the fixed random priorities that it gives the others."""
    return mix64(np.arange(1, bins * bins + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(bins, bins)


def one_permutation(hashes: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """The densified signature of a sorted, non-empty set of hashes."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    full = at[first].astype(np.int64)
    out = np.zeros(bins, np.uint64)
    out[full] = hashes[first]
    if len(full) < bins:
        empty = np.setdiff1d(np.arange(bins), full, assume_unique=True)
        out[empty] = out[full[order[empty][:, full].argmin(1)]]
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """Per signature, one 64-bit key for each band; the band's number is part of it."""
    n, bins = signatures.shape
    parts = signatures.reshape(n, bins // rows, rows)
    key = np.broadcast_to(mix64(np.arange(1, bins // rows + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def signatures(docs: DataFrame, id_column: str, text_column: str, k: int, rows: int, bands: int) -> DataFrame:
    """Per row: id, n (set size), k1 and k2 (a 128-bit hash of the set), bands; nulls for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _borrowing_order(rows * bands)
        for batch in batches:
            sets = [shingle_hashes(word_hashes(x)[0], k) for x in utf8_arrays(batch.column(1))]
            sizes = np.array([len(s) for s in sets], np.int64)
            signed = [one_permutation(s, rows * bands, order) for s in sets if len(s)]
            keys = iter(band_keys(np.array(signed), rows).view(np.int64)) if signed else iter(())
            sums = [[int(mix64(s ^ np.uint64(c)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets] for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), *(pa.array(x, pa.int64()) for x in sums), pa.array([next(keys) if n else None for n in sizes], pa.list_(pa.int64()))],
                ["id", "n", "k1", "k2", "bands"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_column).transform(map_batches, run, f"id {kind}, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs a, b those with 100 * intersection >= percent * union, on the full sets.

    The pairs go to b's text first and then to a's, the star's centre: a centre's text moves once, and adaptive
    execution splits the pairs of a centre that has very many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[bytes, frozenset] = {}
        held = 0
        for batch in batches:
            keep = []
            for x, y in zip(utf8_arrays(batch.column(2)), utf8_arrays(batch.column(3))):
                sets = []
                for text in (x, y):
                    if (s := recent.get(key := text.tobytes())) is None:
                        s = frozenset(shingle_hashes(word_hashes(text)[0], k).tolist())
                        held += len(s)
                        if held > 500_000:  # shingles kept; the sets of one text may be more
                            recent, held = {}, len(s)
                        recent[key] = s
                    sets.append(s)
                both = len(sets[0] & sets[1])
                keep.append(both > 0 and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").transform(map_batches, run, f"a {kind}, b {kind}").distinct()


def block_links(labels: list, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places of linked pairs with different labels; of the links between two labels, as many as join them."""
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    owner: dict = {x: x for x in labels}

    def find(x):  # noqa: ANN001, ANN202
        while owner[x] != x:
            owner[x] = owner[owner[x]]
            x = owner[x]
        return x

    codes = np.unique(np.array([str(x) for x in labels]), return_inverse=True)[1]
    possible = np.triu(codes[:, None] != codes[None, :], 1)
    possible &= 100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes)
    out = []
    if not possible.any():
        return out
    if m <= 16:
        frozen = [frozenset(x.tolist()) for x in sets]
        pairs = [(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(possible))) if 100 * (n := len(frozen[i] & frozen[j])) >= percent * (sizes[i] + sizes[j] - n)]
    else:
        whole = np.concatenate(sets)
        _, column, count = np.unique(whole, return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(m), sizes), count[column] >= 2
        row, column = row[shared], (np.cumsum(count >= 2) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((m, m), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            lo, hi = np.searchsorted(column, [first, first + 4096])
            part = np.zeros((m, 4096), np.float32)
            part[row[lo:hi], column[lo:hi] - first] = 1
            common += part @ part.T
        n = common.astype(np.int64)
        linked = possible & (100 * n >= percent * (sizes[:, None] + sizes[None, :] - n))
        pairs = zip(*(x.tolist() for x in np.nonzero(linked)))
    for i, j in pairs:
        x, y = find(labels[i]), find(labels[j])
        if x != y:
            owner[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _compared(active: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links a, b between members of different labels in the active buckets.

    active: bucket, rep, label, of its bucket's largest label top (the label), and members m and shingles w, and of the
    others rest_m and rest_w. The largest label's members are dealt to the first blocks, by a hash, the others to blocks
    after them; a block of the first kind meets those of the second, these meet each other, each two in one run of a
    sorted partition.
    """
    kind = active.schema["rep"].dataType.simpleString()
    blocks = lambda m, w: F.greatest(F.ceil(F.col(m) / BLOCK), F.ceil(F.col(w) / BLOCK_SHINGLES)).cast("int")
    placed = active.select("bucket", "rep", "label", (F.col("label") == F.col("top")).alias("large"), blocks("m", "w").alias("n0"), blocks("rest_m", "rest_w").alias("n1"))
    placed = placed.withColumn("own", F.when(F.col("large"), F.pmod(F.xxhash64("rep"), F.col("n0"))).otherwise(F.col("n0") + F.pmod(F.xxhash64("rep"), F.col("n1"))).cast("int"))
    met = F.when(F.col("large"), F.expr("sequence(n0, n0 + n1 - 1)")).otherwise(F.expr("sequence(0, n0 + n1 - 1)"))
    placed = placed.withColumn("other", F.explode(met)).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "label")
    rows = placed.join(texts.select(F.col("id").alias("rep"), "text"), "rep").select("bucket", "i", "j", "rep", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, labels, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = block_links(labels, sets, percent) if len(reps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([reps[p[e]] for p in found], id_type) for e in (0, 1)], ["a", "b"])

        for batch in batches:
            id_type = batch.column(3).type
            keys = zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)))
            for now, rep, label, text in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), utf8_arrays(batch.column(5))):
                if now != key:
                    if key is not None and (out := links()).num_rows:
                        yield out
                    key, reps, labels, sets = now, [], [], []
                reps.append(rep)
                labels.append(label)
                sets.append(shingle_hashes(word_hashes(text)[0], k))
        if key is not None:
            yield links()

    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").transform(map_batches, run, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable over links), kept (id = component_id)."""
    with scope() as own:
        return own.finish(_components_of(docs.select(F.col(id_column), F.col(text_column)), id_column, text_column, k, percent, rows, bands), "near-duplicates")


def _components_of(docs: DataFrame, id_column: str, text_column: str, k: int, percent: int, rows: int, bands: int) -> DataFrame:
    sigs = cut(signatures(docs, id_column, text_column, k, rows, bands), "signatures")
    some = sigs.where("n > 0")
    classes = cut(some.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("bands").alias("bands")).where("rep is not null"), "classes")

    # buckets of at least two classes, with the star's centre
    entries = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    stars = entries.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"), F.min_by("n", "rep").alias("centre_n")).where("centre < last")
    members = cut(entries.join(stars.drop("last"), "bucket").distinct(), "buckets")
    involved = members.select(F.col("rep").alias("id")).distinct()
    texts = cut(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(involved, "id", "left_semi"), "texts")

    def alike_in_size(x: str, y: str) -> F.Column:
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    # an id that occurs with several sets joins their classes
    of_id = some.where("id is not null").select("id", F.struct("k1", "k2").alias("s"))
    several = of_id.groupBy("id").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select("id")
    reps = some.select("id", "k1", "k2").join(several, "id").join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    forced = reps.select(F.col("rep").alias("a"), F.col("id").alias("b"))

    tried = cut(members.where("rep <> centre").where(alike_in_size("n", "centre_n")).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = cut(_confirmed(tried, texts, k, percent).unionByName(forced), "links")
    labels = cut(components(links, "a", "b"), "labels")
    labelled = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("label", "rep").alias("label"))
    by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("rep")).alias("p"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("q"))
    split = by_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("w", "m", "label")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w"), F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
    once = split.where("labels > 1").groupBy("m", "p", "q").agg(F.min(F.struct("bucket", "top", "w")).alias("x"))
    once = once.select("x.bucket", F.col("x.top.label").alias("top"), (F.col("m") - F.col("x.top.m")).alias("rest_m"), (F.col("x.w") - F.col("x.top.w")).alias("rest_w"), F.col("x.top.m").alias("m"), F.col("x.top.w").alias("w"))
    found = cut(_compared(labelled.join(once, "bucket"), texts, k, percent), "links")
    if not found.isEmpty():
        labels = cut(components(links.unionByName(found), "a", "b"), "labels")
    groups = classes.select("k1", "k2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("label", "rep").alias("component"))
    component = F.coalesce("component", "id")
    out = sigs.select("id", "n", "k1", "k2").join(cut(groups, "groups"), ["k1", "k2"], "left")
    return out.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings: int) -> DataFrame:
    """The documents with one row of each group of linked rows, all columns: that of the smallest id, or by content among equal ids.

    Decided row by row: ids link nothing. A row that is linked with none stays, without an id or under an id that other
    rows have too; of a group without ids one row stays, and of rows without words all. The rows are numbered in a
    stored table, so that a number is the same whenever it is read.
    """
    numbered = cut(docs.withColumn("_storyloom_row", F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered, "_storyloom_row", text_column, **settings).select("_storyloom_row", "component_id")
    content = F.xxhash64(*[F.col(c) for c in docs.columns if docs.schema[c].dataType.typeName() != "map"])
    order = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), content.alias("content"), F.col("_storyloom_row").alias("row"))
    ranked = numbered.select("_storyloom_row", order.alias("order")).join(groups, "_storyloom_row")
    kept = ranked.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first.row").alias("_storyloom_row"))
    return numbered.join(kept, "_storyloom_row", "left_semi").select(*docs.columns)
