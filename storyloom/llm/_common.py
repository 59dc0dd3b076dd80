"""What several operators of this subpackage share: scratch tables, tokenising and hashing of whole batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Odd multipliers of the word and shingle hashes; any odd 64-bit numbers do.
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_P_INVERSE = pow(_P, -1, 1 << 64)
#: Bytes of an Arrow batch, about, where the session has no setting of its own: both ends of the pipe hold a batch several
#: times over, and the default of 64 MB is too much of an executor's memory. A single longer row is a batch by itself.
BATCH_BYTES, _BATCH_SETTING = 8_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs
    in one process. On a cluster without the setting, ValueError: a folder of one machine would lose rows."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="storyloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


class Scope:
    """The scratch tables and broadcasts made while it is the innermost one open."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []
        self.shared: list = []

    def finish(self, result: DataFrame, name: str) -> DataFrame:
        """Writes the result, and deletes the tables and destroys the broadcasts that it was made from."""
        out, open_ = cut(result, name), _SCOPES.open
        self.tables = [t for t in self.tables if t is not out]
        for t in self.tables:
            drop(t)
        for b in self.shared:
            b.destroy()
        self.tables, self.shared = [], []
        if self in open_[1:]:
            open_[open_.index(self) - 1].tables.append(out)
        return out


class _Scopes(threading.local):
    def __init__(self) -> None:
        self.open: list[Scope] = []


_SCOPES = _Scopes()


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """Within it, what cut() and shared_value() make belongs to the scope, whose finish() clears it away."""
    own = Scope()
    _SCOPES.open.append(own)
    try:
        yield own
    finally:
        _SCOPES.open.remove(own)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._storyloom_path = path  # type: ignore[attr-defined]
    if _SCOPES.open:
        _SCOPES.open[-1].tables.append(out)
    return out


def drop(df: DataFrame | None) -> None:
    """Deletes the table that cut() wrote, once no later plan reads it."""
    path = getattr(df, "_storyloom_path", None)
    if path:
        session = df.sparkSession  # type: ignore[union-attr]
        jvm = session._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(hadoop_path, True)


def shared_value(spark: SparkSession, value):  # noqa: ANN001, ANN201
    """A broadcast of a model or an index of bounded size; within a scope, it ends with the scope."""
    out = spark.sparkContext.broadcast(value)
    if _SCOPES.open:
        _SCOPES.open[-1].shared.append(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a scan of texts in fewer splits than there are cores is dealt to all cores first."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    few = name in ("documents", "pages") and df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df


#: The runtime Bloom filter of a join: bits a key, most bits (Spark's own bound, 8 MB), and the size of a scan that is worth one.
KEY_BITS, MOST_BITS, FILTERED_SCAN = 12, 1 << 26, "64m"


@contextlib.contextmanager
def runtime_filter(spark: SparkSession, keys: int) -> Iterator[None]:
    """Within it, joins that move both sides let Spark drop rows before they move, by a Bloom filter with room for `keys`
    keys of the selective side. It has MOST_BITS at most: of more than some ten million keys it lets most rows by, and the
    join moves them as it would without; its result is the same in any case."""
    place = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {
        "applicationSideScanSizeThreshold": FILTERED_SCAN,
        "creationSideThreshold": "1t",  # the filter's size is bounded, whatever that side's is
        "expectedNumItems": max(1, keys),
        "numBits": min(MOST_BITS, max(1 << 20, KEY_BITS * keys)),
    }
    before = {key: spark.conf.get(place + key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(place + key, str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(place + key, value)


def release_memory() -> None:
    """Gives what this process has freed back to the system; the allocators would keep it for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:  # noqa: ANN001
    """df.mapInArrow(run, schema) by batches of bounded bytes; a worker's freed memory is given back when its task ends."""
    conf = df.sparkSession.conf
    if _BATCH_SETTING not in conf.getAll:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(bounded, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the public splitmix64 constants)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & _MASK], dtype=np.uint64))[0])


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        m = max(n, 2 * len(_POWERS["up"]))
        for key, base in (("up", _P), ("down", _P_INVERSE)):
            p = np.full(m, np.uint64(base & _MASK))
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Separators of plain words: all ASCII but letters and digits. Other characters belong to words.
PLAIN = np.zeros(256, bool)
PLAIN[:128] = [not chr(c).isalnum() for c in range(128)]


def word_hashes(data: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's UTF-8 bytes: the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, as 64-bit hashes with their starts and ends.

    The hash is a polynomial over the bytes modulo 2^64, taken from prefix sums, then mixed; equal words have equal hashes.
    """
    n = len(data)
    if not n:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e
    inside = ~separators[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), starts, ends


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word windows; of the whole sequence where it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    m = min(k, n)
    h = np.full(n - m + 1, np.uint64(m))
    for i in range(m):
        h = mix64(h * np.uint64(_P) + words[i : n - m + 1 + i])
    return np.unique(h)


def utf8_arrays(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The bytes of each text of a string column, without copies; a null is empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for c in chunks:
        if not len(c):
            continue
        large = pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)
        _, offsets, data = c.buffers()
        o = np.frombuffer(offsets, np.int64 if large else np.int32, len(c) + 1, c.offset * (8 if large else 4))
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        valid = c.is_valid().to_numpy(zero_copy_only=False) if c.null_count else None
        for i in range(len(c)):
            yield raw[o[i] : o[i + 1]] if valid is None or valid[i] else raw[:0]
