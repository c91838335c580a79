"""Bounded-space online packing of documents into fixed-length training sequences.

Every partition holds at most `open_windows` windows. A document's whole windows are cut off first; what is left goes into the window
where it leaves the least room. When none fits, the fullest window is filled with the head of the piece and
emitted, and the rest is placed again. Windows still open at the end of a partition are leftovers: they
carry their ids, meet in groups of a bounded number of partitions, and are refilled to whole sequences; the last
remainder of a group is cut into sequences whose lengths are powers of two, which need no padding.

Edge cases: a null or empty text is one end-of-document id; very long texts become runs of whole
sequences; repeated rows are packed once each; an empty table gives no piece. Other columns are ignored. A null doc_id
is kept as null.

A task that is run again after a lost executor makes the same pieces, as a sequence id is made of the partition's
number and a counter.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm import textcore as tc
from clauseframe.llm.word_ids import word_ids

TOKENIZER, END, LENGTH = "word_bpe_49k.json", 2, 4096
OPEN_WINDOWS = 16
MERGED_PARTITIONS = 32  # leftovers of so many partitions meet in one group: 32 * 16 * 16 KB at most

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [c.split()[0] for c in PIECE.split(", ")]
TYPES = [pa.int64()] * 7


class _Window:
    __slots__ = ("parts", "used")

    def __init__(self):
        self.parts, self.used = [], 0


class Packer:
    """The windows of one partition."""

    def __init__(self, length: int, most: int, first_id: int):
        self.length, self.most, self.next_id, self.open, self.rows = length, most, first_id, [], []

    def _emit(self, parts: list[tuple]) -> None:
        at = 0
        for doc, start, n, total, ids in parts:
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total, length = len(ids) // 4, self.length
        start = total - total % length
        for k in range(0, start, length):
            self._emit([(doc, k, length, total, ids[4 * k : 4 * (k + length)])])
        while start < total:
            need = total - start
            fit = min((w for w in self.open if length - w.used >= need), key=lambda w: length - w.used, default=None)
            if fit is None and len(self.open) < self.most:
                fit = _Window()
                self.open.append(fit)
            if fit is None:
                fit = max(self.open, key=lambda w: w.used)
                need = length - fit.used
            fit.parts.append((doc, start, need, total, ids[4 * start : 4 * (start + need)]))
            fit.used += need
            start += need
            if fit.used == length:
                self.open.remove(fit)
                self._emit(fit.parts)

    def refill(self, pieces) -> None:
        """Whole sequences of all pieces in order; the rest as powers of two."""
        pieces = list(pieces)
        left = sum(p[2] for p in pieces)
        parts, room = [], 0
        for doc, start, n, total, ids in pieces:
            k = 0
            while k < n:
                if not room:
                    room = size = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                    left -= size
                take = min(room, n - k)
                parts.append((doc, start + k, take, total, ids[4 * k : 4 * (k + take)]))
                k, room = k + take, room - take
                if not room:
                    self._emit(parts)
                    parts = []


def _pack(path: str, end: int, length: int, most: int):
    def batch_of(rows, left):
        columns = list(zip(*[r + (None,) for r in rows], *[(d, s, n, None, t, None, None, ids) for d, s, n, t, ids in left])) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*TYPES, pa.binary()])], [*COLUMNS, "ids"])

    def run(batches):
        packer = Packer(length, most, TaskContext.get().partitionId() << 32)
        words, tail = word_ids(path), end.to_bytes(4, "little")
        for batch in batches:
            for at, to, _, _ in tc.text_blocks(batch.column("text")):
                docs = batch.column("doc_id").slice(at, to - at).to_pylist()
                for doc, text in zip(docs, batch.column("text").slice(at, to - at).to_pylist()):
                    packer.add(doc, words.ids(text or "") + tail)
                if packer.rows:
                    yield batch_of(packer.rows, [])
                    packer.rows = []
        yield batch_of([], [p for w in packer.open for p in w.parts])

    return run


def _merge(length: int):
    def run(key, table):
        packer = Packer(length, 1, ((1 << 30) + key[0].as_py()) << 32)
        table = table.sort_by([("home", "ascending"), ("place", "ascending")])
        packer.refill(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "ids"))))
        columns = list(zip(*packer.rows)) or [[]] * len(COLUMNS)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], COLUMNS)

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end: int = END, length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece; see PIECE. `length` must be a power of two."""
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    tc.bounded_batches(spark)
    table = tc.text_only(docs).mapInArrow(_pack(tokenizer, end, length, open_windows), PIECE + ", ids binary")
    table = tc.written(table.withColumn("home", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), spark)
    left = table.where("sequence_id IS NULL").withColumn("bucket", F.expr(f"cast(floor(home / {MERGED_PARTITIONS}) as long)"))
    merged = left.groupBy("bucket").applyInArrow(_merge(length), PIECE)
    return table.where("sequence_id IS NOT NULL").select(*COLUMNS).union(merged)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, tc.read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
