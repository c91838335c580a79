"""Vectorised text primitives that run inside tasks, and small Spark helpers.

Texts are taken straight from Arrow buffers and cut into blocks of bounded size, so memory does not
follow the length of a batch. A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BATCH_BYTES, BATCH_CONF = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
READ_ROWS, READ_CONF = 512, "spark.sql.parquet.columnarReaderBatchSize"
SLIM_ROWS = 100_000
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: By the bytes that are left of a word, those that count of the next eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG_WORD = 512
_POWER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What a Python worker keeps from task to task (a vocabulary, words met before): one thing at a time, as workers are reused by later stages."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Drop what is held, and give the memory back to the system."""
    if _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES):
    """Yield (first row, last row, bytes, offsets) of consecutive rows; a null text counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text the offset of its first word."""
    inside = np.concatenate([~_SPACE[data], [False]])
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[1:] = inside[0], inside[1:] != inside[:-1]
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]  # a word ends with its text
    bounds = np.flatnonzero(edge)
    if len(cut):
        bounds = np.sort(np.concatenate([bounds, cut, cut]))
    starts, lengths = bounds[0::2], bounds[1::2] - bounds[0::2]
    counts = np.searchsorted(starts, offsets)
    lower = np.zeros(len(data) + 8, dtype=np.uint8)
    lower[: len(data)] = _LOWER[data]
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=lower, strides=(1,))
    out = lengths.astype(np.uint64) * _STEP
    todo = np.arange(len(starts))
    for k in range(0, LONG_WORD, 8):
        left = np.minimum(lengths[todo] - k, 8)
        part = eight[starts[todo] + k] & _MASKS[left]
        out[todo] = mix(out[todo] * _POWER + part)
        todo = todo[lengths[todo] > k + 8]
        if not len(todo):
            break
    for i in todo:
        word = lower[starts[i] : starts[i] + lengths[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out, counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `size` words, and each text's offset; a shorter text gives its whole sequence."""
    n = np.diff(counts)
    rows = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out_at = np.concatenate([[0], np.cumsum(rows)])
    out = np.zeros(int(out_at[-1]), dtype=np.uint64)
    if len(words) >= size:
        run = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            run = run * _STEP + words[k : len(words) - size + 1 + k]
        full = n >= size
        take = np.repeat(counts[:-1][full] - np.concatenate([[0], np.cumsum(rows[full])])[:-1], rows[full])
        put = np.repeat(out_at[:-1][full] - np.concatenate([[0], np.cumsum(rows[full])])[:-1], rows[full])
        step = np.arange(int(rows[full].sum()))
        out[put + step] = mix(run[take + step])
    for i in np.flatnonzero((n > 0) & (n < size)):
        run = np.uint64(0)
        for w in words[counts[i] : counts[i + 1]]:
            run = np.uint64((int(run) * int(_STEP) + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out[out_at[i]] = mix(np.array([run ^ np.uint64(n[i])], dtype=np.uint64))[0]
    return out, out_at


def sorted_sets(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes as ascending signed longs, and the offsets."""
    h = hashes.view(np.int64).copy()
    for i in range(len(at) - 1):
        h[at[i] : at[i + 1]].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = h[1:] != h[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    keep[heads] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def shared_folder(spark: SparkSession) -> str:
    """The folder of this session that driver and executors share."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file:///tmp/checkpoints/clauseframe"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """From now on this session's tasks get rows in Arrow batches of about BATCH_BYTES, and read READ_ROWS at a time; bounds that the user has set stay.

    By Spark's defaults 10,000 rows make a batch and 4,096 are read at once, whatever their texts: executors and their Python workers hold each batch several times.
    """
    for conf, bound in ((BATCH_CONF, BATCH_BYTES), (READ_CONF, READ_ROWS)):
        if spark.conf.get(conf, None) is None:
            spark.conf.set(conf, str(bound))


def local_table(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A small table of the driver, by Arrow: rows in Python would start Python workers of another kind on the executors, beside those that stages use."""
    return spark.createDataFrame(pa.table(columns))


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows at most, of a few numbers each: as many partitions as cores, or of SLIM_ROWS rows if these are more.

    On a local folder an executor starts a process (chmod) for every file that it writes, and is counted twice until that is up.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SLIM_ROWS)))


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, whichever executor is lost."""
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_only(docs: DataFrame, *others: str) -> DataFrame:
    """The columns that an operator needs, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others)
