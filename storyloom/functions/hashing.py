"""Keys and MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Permutations and bands of a signature; hashes are modulo the prime 2^31 - 1.
PERMUTATIONS, BANDS = 64, 16
PRIME = (1 << 31) - 1


def coefficients(n: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """Multiplier and addend of each permutation, from a fixed rule."""
    out, x = [], 20240101
    for _ in range(n):
        x = (x * 48271) % PRIME
        a = x
        x = (x * 48271) % PRIME
        out.append((a, x))
    return out


def idempotency_key(kind: Column, subject: Column, discriminator: Column) -> Column:
    return F.sha2(F.concat_ws("|", kind, subject, discriminator), 256)


def author_hash(salt: str, platform: Column, handle: Column) -> Column:
    """Null without a handle or salt."""
    name = F.lower(F.trim(handle))
    return F.when((F.length(name) > 0) & F.lit(bool(salt)), F.sha2(F.concat_ws("|", F.lit(salt), platform, name), 256))


#: Hashes whose permutations are taken at once, so that they stay in a core's cache.
HASHES = 1 << 15


def minima(hashes: pa.Array, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Which of the arrays of hashes (from 0 to PRIME - 1) have any, and for each of these the least of each permutation."""
    flat = hashes.flatten()
    row = np.repeat(np.arange(len(hashes)), np.array(pc.fill_null(pc.list_value_length(hashes), 0), np.int64))
    row, x = row[np.array(flat.is_valid())], flat.drop_null().to_numpy()
    first = np.flatnonzero(np.diff(row, prepend=-1))
    out, at, ends = np.empty((len(first), permutations), np.int64), 0, np.append(first[1:], len(x))
    while at < len(first):
        upto = max(at + 1, int(np.searchsorted(ends, first[at] + HASHES, "right")))
        part, starts = x[first[at] : ends[upto - 1]], first[at:upto] - first[at]
        for i, (a, b) in enumerate(coefficients(permutations)):
            y = part * a + b  # below 2^62; modulo 2^31 - 1 the high bits count as low ones
            y = (y & PRIME) + (y >> 31)
            np.subtract(y, PRIME, out=y, where=y >= PRIME)
            out[at:upto, i] = np.minimum.reduceat(y, starts)
        at = upto
    return row[first], out


def minhash(df: DataFrame, id_column: str, shingle_array: str, permutations: int = PERMUTATIONS) -> DataFrame:
    """id, signature: minima of each row in Arrow batches, so no shingle becomes a row, then of the rows that share an id.

    A shingle is hashed once (31 bits of its md5) and permuted by multiplication modulo a prime. Ids without
    shingles are left out.
    """
    x = F.transform(shingle_array, lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % PRIME)
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("h", T.ArrayType(T.LongType()))])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, least = minima(batch.column(1), permutations)
            upto = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * permutations)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(upto, pa.array(least.ravel()))], schema.names)

    out = df.select(id_column, x.alias("h")).mapInArrow(reduced, schema)
    out = out.groupBy(id_column).agg(*[F.min(F.get("h", F.lit(i))).alias(f"h{i}") for i in range(permutations)])
    return out.select(id_column, F.array(*[f"h{i}" for i in range(permutations)]).alias("signature"))


def band_keys(signature: Column, permutations: int = PERMUTATIONS, bands: int = BANDS) -> Column:
    rows = permutations // bands
    keys = [F.md5(F.concat_ws(",", F.lit(b), *[signature[b * rows + r] for r in range(rows)])) for b in range(bands)]
    return F.array(*keys)


def estimated_jaccard(a: Column, b: Column, permutations: int = PERMUTATIONS) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(permutations))


def collision_rate(similarity: Column, rows: int, bands: int) -> Column:
    """The chance that two sets of this similarity share a band."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(rows)), F.lit(bands))
