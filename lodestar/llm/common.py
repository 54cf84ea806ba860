"""Helpers that the training-data operators share: tables, shared storage, byte and word hashing in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.ship import ship

#: Odd 64-bit constants: the base of the polynomial hash and the steps of the finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MASK = (1 << 64) - 1
#: Raw bytes that one numpy pass works on at most (a longer single text is one pass).
CHUNK_BYTES = 1 << 20


#: By application, where spark.checkpoint.dir is unset.
_OWN_ROOT: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests);
    on a cluster that is an error."""
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or _OWN_ROOT.get(spark.sparkContext.applicationId)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN_ROOT[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestar-")
    # with its scheme, so that Spark and the tasks that write files themselves mean the same place
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + full[5:] if re.match("file:/[^/]", full) else full


#: Folders made within each open scratch().
_SCRATCH: list[list[str]] = []


def shared_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators stored within it. Results that are still lazy must be written before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            discard(spark, path)


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """df written to shared storage and read back: lineage ends here, and lost executors lose nothing."""
    path = path or shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean_docs(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, text (null: empty) and the columns to keep; extra columns go, whatever their names."""
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in keep],
    )


def give_back() -> None:
    """Return freed memory to the system: workers are kept for later tasks, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- numpy hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


#: A space and the bytes 9 to 13 part words; no byte of a multi-byte UTF-8 character is among them.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: equal spans have equal hashes wherever they stand."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Bytes over which a word is hashed by BLAKE2b.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, mixed after every 8 bytes: no structure of the bytes makes spans collide."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    out = mix(size.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))
    open_ = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        open_ = open_[size[open_] > at]
        if not len(open_):
            break
        left = np.minimum(size[open_] - at, 8).astype(np.uint64)
        some = eight[starts[open_] + at].astype(np.uint64) & (np.uint64(MASK) >> (np.uint64(64) - np.uint64(8) * left))
        out[open_] = mix(out[open_] * np.uint64(MIX_B) + some)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-aware hashes of the runs of n consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(BASE) + words[i : i + count]
    return mix(out)


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows, without a Python object for each row."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets


def byte_groups(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most limit bytes each, or a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
