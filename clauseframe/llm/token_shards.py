"""Training-order materialisation of token ids as fixed-stride binary shards.

Every partition's documents become one stream of ids (each document followed by the end id), cut into sequences of `length`
ids. The sequences are numbered densely over all partitions. A keyed Feistel permutation of that range, by
cycle-walking where its power-of-four domain is larger, gives each sequence its global slot. Shard k holds slots
k * per_shard ... in order, each sequence on the same number of bytes, so a reader finds slot s at
(s % per_shard) * stride and resumes anywhere; the same key gives the same order again.

Ids are little-endian unsigned 16-bit. The last sequence of a partition is filled with the end id.

Edge cases: null and empty texts are one end id; very long texts run over many sequences; repeated rows are written each;
an empty table gives no shard. Other columns are ignored.

The tokenised sequences are written once to the shared folder, so a lost executor can't renumber them; a shard is made by one task
from a bounded number of rows. `write_shards` stores the shards as files, each under a temporary name first; `read_from` reads on from any slot.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm import textcore as tc

RANKS, END = "byte_bpe_50k.tiktoken", 50256
LENGTH, PER_SHARD, KEY = 1024, 2048, 20240229
ROUNDS = 6
CACHED = 250_000


class ByteIds:
    """Ids of a byte-level BPE; a word with the white space before it is remembered."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut, self.known = regex.compile(r"\s*\S+|\s+"), {}

    def ids(self, text: str) -> bytes:
        # no token crosses from other characters to white space, so these parts are encoded alone
        known, parts = self.known, self.cut.findall(text)
        if len(known) > CACHED:
            known.clear()
        for part in parts:
            if part not in known:
                known[part] = array("H", self.encode(part)).tobytes()
        return b"".join(map(known.__getitem__, parts))


def _ids(path: str) -> ByteIds:
    return tc.held(f"byte ids {path}", lambda: ByteIds(path))


def _sequences(path: str, end: int, length: int):
    def run(batches):
        encoder, tail, held, k = _ids(path), end.to_bytes(2, "little"), b"", 0
        for batch in batches:
            for at, to, _, _ in tc.text_blocks(batch.column("text")):
                parts = [held]
                for text in batch.column("text").slice(at, to - at).to_pylist():
                    parts += [encoder.ids(text or ""), tail]
                held = b"".join(parts)
                whole = len(held) // (2 * length)
                if whole:
                    some = [held[2 * length * i : 2 * length * (i + 1)] for i in range(whole)]
                    held = held[2 * length * whole :]
                    yield pa.RecordBatch.from_arrays([pa.array(range(k, k + whole), pa.int64()), pa.array([length] * whole, pa.int64()), pa.array(some, pa.binary())], ["k", "n", "ids"])
                    k += whole
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(held) // 2], pa.int64()), pa.array([held + tail * (length - len(held) // 2)], pa.binary())], ["k", "n", "ids"])

    return run


def permuted(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed bijection of 0..n-1."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = tc.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (tc.mix(right + k) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _shard(length: int, per_shard: int):
    def run(key, table):
        table = table.sort_by("slot")
        payload = b"".join(table.column("ids").to_pylist())
        row = [int(key[0].as_py()), int(key[0].as_py()) * per_shard, table.num_rows, 2 * length, sum(table.column("n").to_pylist()), hashlib.sha256(payload).hexdigest(), payload]
        return pa.table([pa.array([x], t) for x, t in zip(row, [pa.int64()] * 5 + [pa.string(), pa.binary()])], names=["shard_id", "first_slot", "n_sequences", "stride_bytes", "n_tokens", "sha256", "payload"])

    return run


def materialise(spark: SparkSession, docs: DataFrame, ranks: str, end: int = END, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """docs (doc_id, text) -> a row for each shard, with its bytes."""
    made = tc.text_only(docs).mapInArrow(_sequences(ranks, end, length), "k long, n long, ids binary").withColumn("part", F.spark_partition_id())
    made = tc.written(made, spark)
    # one number for each input partition, not for each sequence
    sizes = sorted((r["part"], r["c"]) for r in made.groupBy("part").agg(F.count("*").alias("c")).collect())
    first, total = [], 0
    for part, c in sizes:
        first.append((part, total))
        total += c
    base = spark.createDataFrame(first, "part int, base long")
    slot = F.pandas_udf(lambda i: pd.Series(permuted(i.to_numpy(), total, key)), "long")
    placed = made.join(F.broadcast(base), "part").select(slot(F.col("base") + F.col("k")).alias("slot"), "n", "ids")
    placed = placed.withColumn("shard", F.expr(f"cast(floor(slot / {per_shard}) as long)"))
    schema = "shard_id long, first_slot long, n_sequences long, stride_bytes long, n_tokens long, sha256 string, payload binary"
    return placed.groupBy("shard").applyInArrow(_shard(length, per_shard), schema)


def write_shards(shards: DataFrame, uri: str) -> DataFrame:
    """Store each shard as a file under `uri` (any file system that pyarrow opens); returns the files written.

    A file gets its name only when it is whole, and a shard whose file is there already is left, so a job can be resumed.
    """

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        store.create_dir(top, recursive=True)
        for batch in batches:
            names = []
            for shard_id, payload in zip(batch.column("shard_id").to_pylist(), batch.column("payload").to_pylist()):
                name = f"{top}/shard-{shard_id:09d}.bin"
                info = store.get_file_info(name)
                if not (info.is_file and info.size == len(payload)):
                    part = f"{name}.{hashlib.sha256(payload).hexdigest()[:8]}.part"
                    with store.open_output_stream(part) as out:
                        out.write(payload)
                    store.move(part, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("shard_id"), pa.array(names, pa.string())], ["shard_id", "file"])

    return shards.select("shard_id", "payload").mapInArrow(run, "shard_id long, file string")


def read_from(spark: SparkSession, uri: str, first: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, ids) of `count` sequences from slot `first` on, read from the files of write_shards.

    Only the bytes of these slots are read, each file from its place on; a partition is one shard. A slot that isn't stored is an error.
    """
    stride, last = 2 * length, first + count

    def run(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                low, high = max(first, shard * per_shard), min(last, (shard + 1) * per_shard)
                with store.open_input_file(f"{top}/shard-{shard:09d}.bin") as file:
                    file.seek((low - shard * per_shard) * stride)
                    data = file.read((high - low) * stride)
                if len(data) != (high - low) * stride:
                    raise ValueError(f"shard {shard} ends before slot {high}")
                ids = pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(data, "<u2").astype(np.int32)), length).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(range(low, high), pa.int64()), ids], ["slot", "ids"])

    if count <= 0:
        return spark.createDataFrame([], "slot long, ids array<int>")
    begin, end = first // per_shard, (last - 1) // per_shard + 1
    return spark.range(begin, end, 1, min(end - begin, 10_000)).mapInArrow(run, "slot long, ids array<int>")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(spark, tc.read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
