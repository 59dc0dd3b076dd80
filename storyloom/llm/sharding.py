"""Shards that each match the corpus mixture: proportional stratified interleaving.

Rows get a seeded random order within their source; the row of rank r among n has the fraction (r - u) / n, with u a
seeded number in (0, 1) for each source, so that sources of one size don't step together. All rows sorted by fraction interleave the sources in proportion, and cutting that order into equal parts gives shards
whose row counts differ by one at most and whose share of every source is that of the corpus, up to a few rows.

Both ranks are taken in two levels: rows fall into buckets of the sort key, the buckets' sizes are summed up in
order, and a window ranks within a bucket alone. A hot source is thus spread over all buckets, and only lean rows
(no text) are moved.

Defined cases: a null source is a stratum of its own; a null or empty text counts no bytes; rows with equal ids and
texts are told apart by nothing and may swap places; a shard stays empty where there are fewer rows than shards; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm._common import cut, map_batches, utf8_arrays

#: Buckets of the random order and of the fractions; a power of two. A bucket holds rows / BUCKETS rows of a sort.
BUCKETS = 4096


def with_crc32(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """Per row: id, source, bytes (of the text in UTF-8), crc (unsigned CRC-32 of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(utf8_arrays(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64())],
                ["id", "source", "bytes", "crc"],
            )

    kinds = [docs.schema[c].dataType.simpleString() for c in (id_column, source_column)]
    return docs.select(id_column, source_column, text_column).transform(map_batches, run, f"id {kinds[0]}, source {kinds[1]}, bytes bigint, crc bigint")


def _ranked(rows: DataFrame, within: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """Adds the rank (from 1) of each row in the order (bucket, order) within groups of equal `within` columns."""
    sizes = rows.groupBy(*within, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*within, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, bucket).orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(inside))
    match = [ranked[c].eqNullSafe(starts[c]) for c in [*within, bucket]]
    return ranked.join(starts, match).select(*[ranked[c] for c in rows.columns], (F.col("_r") + F.col("_before")).alias(name))


def stratified_shards(docs: DataFrame, shards: int, seed: int = 20240, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Per row: id, source, bytes, crc, rank (in its source), fraction, shard (from 0), slot (its place in the shard, from 0)."""
    lean = with_crc32(docs, id_column, text_column, source_column)
    lean = lean.withColumn("h", F.xxhash64(F.lit(seed), "id", "crc")).withColumn("b", F.shiftrightunsigned("h", 64 - BUCKETS.bit_length() + 1).cast("int"))
    lean = cut(lean, "lean")
    ranked = _ranked(lean, ["source"], "b", ["h", "id", "crc", "bytes"], "rank")
    offset = (F.pmod(F.xxhash64(F.lit(seed + 1), ranked["source"]), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    of_source = lean.groupBy("source").agg(F.count("*").alias("_all"))
    ranked = ranked.join(of_source, ranked["source"].eqNullSafe(of_source["source"])).select(
        *[ranked[c] for c in ranked.columns], ((F.col("rank") - offset) / F.col("_all")).alias("fraction")
    )
    ranked = cut(ranked.withColumn("f", F.floor(F.col("fraction") * BUCKETS).cast("int")).drop("b"), "fractions")
    placed = _ranked(ranked, [], "f", ["fraction", F.col("source").asc_nulls_first(), "rank"], "place")
    total = max(ranked.count(), 1)
    shard = F.expr(f"cast((place - 1) * {shards} div {total} as int)")
    first = F.expr(f"(shard * {total}L + {shards} - 1) div {shards}")  # the smallest place that falls into the shard
    return placed.withColumn("shard", shard).withColumn("slot", F.col("place") - 1 - first).select("id", "source", "bytes", "crc", "rank", "fraction", "shard", "slot")
