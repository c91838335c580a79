"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item of n words has n - 4 five-word shingles (shorter items: the whole sequence is one). Every document window of
as many shingles as an item that can reach the similarity at all gets a SimHash of 512 bits; to reach it, enough of its
shingles must stand in the benchmark's items of that size, which running sums tell. Shingles of other sizes' items don't count:
within a passage of a long item, every window of a shorter one's size is made of benchmark shingles.

Fingerprints are matched by multi-index Hamming blocks: 64 blocks of 8 bits, each with an index from its value to the items. If two
fingerprints differ in at most RADIUS bits, at most RADIUS // 3 blocks differ in three bits or more; so each block is looked
up with the 37 values within two bits, and an item found in all other blocks at least is within reach. Few pairs that are not
near pass that count (for random fingerprints about one in 100,000), and no pair within the radius is lost. Candidates
are then verified exactly by the weighted Jaccard similarity of their shingle multisets (sum of the smaller counts by sum of the larger).

The items of a size have an index for each cell of about CELL of them; a window is looked up in the cells of the anchors it holds (`Cells`).

With similarity 0.75 fingerprints differ in 88 bits on average, with a standard deviation of 8.5; the default radius is 128.

A Spark job shingles the benchmark and indexes it in blocks of bounded size, each of which is broadcast by itself. One block is held against
the documents at once. If there are more, documents are still read once: a bitmap of SLOTS bits over all shingles of the benchmark, put together by
Spark, finds every stretch of a document that an item-sized window may come from, and these stretches, written as a table, are held against
block after block. The bitmap says yes too often at worst, so no window is lost. The driver sees one block, the bitmap and the sizes of items
that occur (n sizes take n * n / 2 words).

Edge cases: null or blank documents and items match nothing; a document with fewer words than an item is one window;
repeated documents give repeated hits, repeated items (by item_id) one, their best; of equally similar windows the first is reported; an empty
benchmark or table gives no hit. Other columns are ignored by `contamination` and kept by `without_contaminated`.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm import textcore as tc

RADIUS, PERCENT = 128, 75
WORDS = 8
BLOCKS = 8 * WORDS
WITHIN = 2
BLOCK_TEXT = 4_000_000  # bytes of items that are held at once
STRETCH = 2_048
CELL = 16  # items that share an index, about
SLOTS = 1 << 27
CHUNK = 1 << 15  # bits of a bitmap that Spark puts together at once
_BITS = np.arange(64, dtype=np.uint64)
#: What makes a block's value another one within two bits.
_NEAR = np.array([x for x in range(256) if x.bit_count() <= WITHIN], dtype=np.int64)
_FIRST = np.arange(BLOCKS, dtype=np.int64) * 256


def possible(known: np.ndarray, size: int, span: int, percent: int) -> np.ndarray:
    """Where windows of `span` shingles begin that may be as similar to an item of `size`; known: running number of shingles that such items may have."""
    # both of them share at most the known shingles of the window
    need = percent * (span + size)
    if span >= len(known) or (100 + percent) * known[-1] < need:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero((100 + percent) * (known[span:] - known[: len(known) - span]) >= need)


def running(hits: np.ndarray, n: int) -> np.ndarray:
    known = np.zeros(n + 1, dtype=np.int64)
    known[hits + 1] = 1
    return np.cumsum(known)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of hashes[start:end] for each window, as rows of bytes, by running sums of the bits."""
    out = np.empty((len(starts), BLOCKS), dtype=np.uint8)
    half = (ends - starts)[:, None]
    for k in range(WORDS):
        word = tc.mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF))
        sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
        np.cumsum((word[:, None] >> _BITS) & np.uint64(1), axis=0, dtype=np.int32, out=sums[1:])
        out[:, 8 * k : 8 * k + 8] = np.packbits(2 * (sums[ends] - sums[starts]) > half, axis=1, bitorder="little")
    return out


class Index:
    """The items of one size: their fingerprints, by the values of their blocks."""

    def __init__(self, names: list[int], items: list[np.ndarray], radius: int):
        self.names = names
        self.counts = [np.unique(h, return_counts=True) for h in items]
        self._look_up(np.concatenate([fingerprints(h, np.array([0]), np.array([len(h)])) for h in items]), radius)
        self.starts = self._starts()

    def _look_up(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius, self.need = prints, radius, BLOCKS - radius // (WITHIN + 1)
        keys = (_FIRST + prints).ravel()
        order = np.argsort(keys, kind="stable")
        self.items, self.starts = (order // BLOCKS).astype(np.int32), None

    def _starts(self) -> np.ndarray:
        sizes = np.bincount((_FIRST + self.prints).ravel(), minlength=256 * BLOCKS)
        return np.concatenate([[0], np.cumsum(sizes)])

    def part(self, items: np.ndarray) -> Index:
        """An index of some of the items, made when it is asked."""
        out = Index.__new__(Index)
        out.names, out.counts = [self.names[k] for k in items], [self.counts[k] for k in items]
        out._look_up(self.prints[items], self.radius)
        return out

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a window and an item within the radius, and their distances."""
        if self.need <= 0:  # a radius so wide that blocks rule nothing out
            w, k = (x.ravel() for x in np.indices((len(prints), len(self.names))))
        else:
            starts = self._starts() if self.starts is None else self.starts
            key = (_FIRST[None, :, None] + (prints[:, :, None] ^ _NEAR)).reshape(len(prints), -1)
            low = starts[key].ravel()
            count = starts[key + 1].ravel() - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            window = np.repeat(np.repeat(np.arange(len(prints)), key.shape[1]), count)
            pair, found = np.unique(window * len(self.names) + self.items[at], return_counts=True)
            w, k = np.divmod(pair[found >= self.need], len(self.names))
        distance = np.bitwise_count(prints[w] ^ self.prints[k]).sum(axis=1, dtype=np.int64)
        close = distance <= self.radius
        return w[close], k[close], distance[close]

    def shared(self, k: int, window: np.ndarray) -> int:
        """The sum of the smaller counts of the shingles of a window and an item."""
        names, counts = self.counts[k]
        own, often = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        return int(np.minimum(often, counts[at])[names[at] == own].sum())


class Cells:
    """The items of one size, in cells of about CELL, so that what a window is compared with does not grow with the benchmark.

    An item of n shingles of which a window must share s has its n - s + 1 smallest as anchors: one of them at least is shared.
    An item stands in the cells of its anchors, and a window is looked up in the cells of the anchors that it holds.
    """

    def __init__(self, names: list[int], items: list[np.ndarray], radius: int, percent: int):
        self.whole, self.anchors = Index(names, items, radius), None
        size = len(items[0])
        own = [np.unique(np.sort(h)[: size - -(-percent * size // 100) + 1]) for h in items]
        many = 1 << (sum(map(len, own)) // CELL).bit_length()
        if len(items) <= CELL or percent <= 0:
            return
        self.whole.items = self.whole.starts = None  # asked by parts only
        self.anchors, self.mask = np.unique(np.concatenate(own)), np.uint64(many - 1)
        cell = (np.concatenate(own) & self.mask).astype(np.int64)
        pairs = np.unique(cell * len(items) + np.repeat(np.arange(len(items)), [len(a) for a in own]))
        cell, item = np.divmod(pairs, len(items))
        heads = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cells = dict(zip(cell[heads].tolist(), np.split(item, heads[1:])))

    def of(self, hashes: np.ndarray, hits: np.ndarray, starts: np.ndarray, span: int):
        """(an index, which of the windows are to be looked up in it), for windows of `span` from `starts`."""
        if self.anchors is None:
            yield self.whole, np.arange(len(starts))
            return
        own = hashes[hits]
        at = np.minimum(np.searchsorted(self.anchors, own), len(self.anchors) - 1)
        hits = hits[self.anchors[at] == own]
        cell = (hashes[hits] & self.mask).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        heads = np.flatnonzero(np.diff(cell[order], prepend=-1))
        for c, places in zip(cell[order][heads].tolist(), np.split(hits[order], heads[1:])):
            after = np.searchsorted(places, starts)
            inside = np.flatnonzero((after < len(places)) & (places[np.minimum(after, len(places) - 1)] < starts + span))
            if len(inside):
                yield self.whole.part(self.cells[c]), inside


class Items:
    """Benchmark items with equal shingle width, indexed by window size."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]], radius: int, percent: int):
        self.width = width
        self.all = np.unique(np.concatenate([h for _, h in items]))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.all & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        sizes: dict[int, list] = {}
        for item, h in items:
            sizes.setdefault(len(h), []).append((item, h))
        self.by_size = {size: Cells([i for i, _ in some], [h for _, h in some], radius, percent) for size, some in sizes.items()}
        self.sizes = np.array(list(sizes), dtype=np.int64)
        # the shingles of each size as places in `all`, and the sizes (as numbers) of each shingle
        self.own = [np.unique(np.searchsorted(self.all, np.concatenate([h for _, h in some]))).astype(np.int32) for some in sizes.values()]
        place = np.concatenate(self.own)
        self.numbers = np.repeat(np.arange(len(self.own), dtype=np.int32), [len(o) for o in self.own])[np.argsort(place, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.all)))])

    def known(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.all, hashes[maybe]), len(self.all) - 1)
        return maybe[self.all[at] == hashes[maybe]]

    def in_reach(self, hashes: np.ndarray, hits: np.ndarray, percent: int, total: int):
        """(size, which of the hits are shingles of its items) for the sizes of which a stretch has enough of them for a window."""
        at = np.searchsorted(self.all, hashes[hits]).astype(np.int32)
        place, often = np.unique(at, return_counts=True)
        each = self.first[place + 1] - self.first[place]
        numbers = self.numbers[np.repeat(self.first[place] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        hits_of = np.bincount(numbers, weights=np.repeat(often, each), minlength=len(self.sizes))
        enough = (100 + percent) * hits_of >= percent * (np.minimum(self.sizes, total) + self.sizes)
        for k in np.flatnonzero(enough).tolist():
            own = self.own[k]
            yield int(self.sizes[k]), hits[own[np.minimum(np.searchsorted(own, at), len(own) - 1)] == at]

    def search(self, hashes: np.ndarray, hits: np.ndarray, percent: int, total: int):
        """The best window of each item in a stretch of a document of `total` shingles: (item, start, shingles, similarity, distance)."""
        for size, hits_of in self.in_reach(hashes, hits, percent, total):
            cells, span = self.by_size[size], min(size, total)
            starts = possible(running(hits_of, len(hashes)), size, span, percent)
            best: dict[int, tuple] = {}
            for some in np.split(starts, np.flatnonzero(np.diff(starts) > STRETCH) + 1):
                for at in range(0, len(some), STRETCH):
                    part = some[at : at + STRETCH]
                    low, high = part[0], part[-1] + span
                    prints = fingerprints(hashes[low:high], part - low, part - low + span)
                    own = hits_of[np.searchsorted(hits_of, low) : np.searchsorted(hits_of, high)]
                    for index, windows in cells.of(hashes, own, part, span):
                        step = max(1, 4_000_000 // (BLOCKS * max(len(index.names), 16)))
                        for first in range(0, len(windows), step):
                            asked = windows[first : first + step]
                            for w, k, d in zip(*index.near(prints[asked])):
                                start = int(part[asked[w]])
                                both = index.shared(k, hashes[start : start + span])
                                either = span + size - both
                                if 100 * both >= percent * either:
                                    _better(best, index.names[k], start, span, both / either, int(d))
            for item, (similarity, start, d, _) in best.items():
                yield item, -start, span, similarity, d


class Sieve:
    """All shingles of a benchmark as a bitmap, and its items' sizes by shingle width."""

    def __init__(self, chunks: list[tuple[int, bytes]], sizes: list[tuple[int, int]]):
        self.bits = np.zeros((SLOTS // CHUNK, CHUNK // 8), dtype=np.uint8)
        for k, bits in chunks:
            self.bits[k] = np.frombuffer(bits, dtype=np.uint8)
        self.bits = self.bits.ravel()
        self.sizes: dict[int, list[int]] = {}
        for width, size in sizes:
            self.sizes.setdefault(width, []).append(size)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        slot = _slots(hashes)
        return np.flatnonzero(self.bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)

    def stretches(self, width: int, hits: np.ndarray, n: int, percent: int):
        """(from, to) of what windows cover that an item may be similar to."""
        known, edge = running(hits, n), np.zeros(n + 1, dtype=np.int64)
        for size in self.sizes[width]:
            span = min(size, n)
            starts = possible(known, size, span, percent)
            edge[starts] += 1
            edge[starts + span] -= 1
        covered = np.concatenate([[False], np.cumsum(edge) > 0])
        bounds = np.flatnonzero(covered[1:] != covered[:-1])
        return zip(bounds[0::2].tolist(), bounds[1::2].tolist())


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _with_hits(words: np.ndarray, counts: np.ndarray, width: int, known):
    """(row, its shingles, places of those that are known) of each text of a block that has one."""
    hashes, at = tc.shingle_hashes(words, counts, width)
    if width < tc.SHINGLE:  # a text shorter than the item holds no whole item
        short = np.flatnonzero((np.diff(counts) > 0) & (np.diff(counts) < width))
        hashes = hashes.copy()
        hashes[at[short]] = 0
    places = known(hashes)
    rows = np.searchsorted(at, places, side="right") - 1
    heads = np.flatnonzero(np.diff(rows, prepend=-1))
    for row, own in zip(rows[heads].tolist(), np.split(places, heads[1:])):
        yield row, hashes[at[row] : at[row + 1]], own - at[row]


def _better(best: dict, key, start: int, n_words: int, similarity: float, distance: int) -> None:
    new = (similarity, -start, distance, n_words)
    best[key] = max(best.get(key, new), new)


def _scan(broadcast, percent: int, flag: str | None):
    """Rows with hits, or all columns with a flag for the rows that have one."""

    def run(batches):
        tc.release()
        for batch in batches:
            found, dirty = [], np.zeros(batch.num_rows, dtype=bool)
            for first, to, data, offsets in tc.text_blocks(batch.column("text")):
                best: dict[tuple, tuple] = {}
                words, counts = tc.word_hashes(data, offsets)
                for group in broadcast.value:
                    for row, hashes, hits in _with_hits(words, counts, group.width, group.known):
                        for item, start, size, similarity, d in group.search(hashes, hits, percent, len(hashes)):
                            _better(best, (row, item), start, size + group.width - 1, similarity, d)
                ids = batch.column("doc_id").slice(first, to - first) if flag is None else None
                for (row, item), (similarity, start, d, n) in best.items():
                    dirty[first + row] = True
                    if ids is not None:
                        found.append((ids[row].as_py(), item, -start, n, similarity, d))
            if flag is not None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dirty)], [*batch.schema.names, flag])
            elif found:
                yield _batch(found, HIT)

    return run


HIT = {"doc_id": pa.int64(), "item_id": pa.int64(), "start_word": pa.int64(), "n_words": pa.int64(), "similarity": pa.float64(), "distance": pa.int64()}
HIT_SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double, distance long"
ROW_HIT, ROW_HIT_SCHEMA = {"row": pa.int64()} | HIT, f"row long, {HIT_SCHEMA}"
STRETCHES = {"row": pa.int64(), "doc_id": pa.int64(), "width": pa.int32(), "start": pa.int64(), "total": pa.int64(), "hashes": pa.binary()}
STRETCHES_SCHEMA = "row long, doc_id long, width int, start long, total long, hashes binary"


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))


def _sift(broadcast, percent: int):
    """The stretches of documents (row, doc_id, text) that may be like an item, as shingles."""

    def run(batches):
        tc.release()
        for batch in batches:
            for first, to, data, offsets in tc.text_blocks(batch.column("text")):
                sieve, found = broadcast.value, []
                words, counts = tc.word_hashes(data, offsets)
                for width in sieve.sizes:
                    for row, hashes, hits in _with_hits(words, counts, width, sieve.known):
                        for low, high in sieve.stretches(width, hits, len(hashes), percent):
                            names = (batch.column(c)[first + row].as_py() for c in ("row", "doc_id"))
                            found.append((*names, width, low, len(hashes), hashes[low:high].tobytes()))
                if found:
                    yield _batch(found, STRETCHES)

    return run


def _held_against(broadcast, percent: int):
    """Hits of one block of items in stretches."""

    def run(batches):
        groups = {group.width: group for group in broadcast.value}
        for batch in batches:
            best: dict[tuple, tuple] = {}
            for row, doc_id, width, low, total, own in zip(*(batch.column(c).to_pylist() for c in STRETCHES)):
                if width in groups:
                    hashes = np.frombuffer(own, dtype=np.uint64)
                    for item, start, size, similarity, d in groups[width].search(hashes, groups[width].known(hashes), percent, total):
                        _better(best, (row, doc_id, item), low + start, size + width - 1, similarity, d)
            if best:
                yield _batch([(*key, -start, n, similarity, d) for key, (similarity, start, d, n) in best.items()], ROW_HIT)

    return run


def _shingled(batches):
    """Items (block, item_id, text) as shingles; those without a word go."""
    for batch in batches:
        for first, to, data, offsets in tc.text_blocks(batch.column("text")):
            words, counts = tc.word_hashes(data, offsets)
            of_width = {w: tc.shingle_hashes(words, counts, w) for w in np.unique(np.minimum(np.diff(counts), tc.SHINGLE)).tolist() if w}
            found = []
            for k, n in enumerate(np.minimum(np.diff(counts), tc.SHINGLE).tolist()):
                if n:
                    hashes, at = of_width[n]
                    found.append((batch.column("block")[first + k].as_py(), batch.column("item_id")[first + k].as_py(), n, hashes[at[k] : at[k + 1]].tobytes()))
            if found:
                yield _batch(found, {"block": pa.int64(), "item_id": pa.int64(), "width": pa.int32(), "hashes": pa.binary()})


def _slots_of(batches):
    for batch in batches:
        slots = [_slots(np.frombuffer(h, dtype=np.uint64)) for h in batch.column("hashes").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *slots])))], ["slot"])


def _indexed(radius: int, percent: int):
    def build(table: pa.Table) -> pa.Table:
        groups: dict[int, list] = {}
        for item, width, own in zip(*(table.column(c).to_pylist() for c in ("item_id", "width", "hashes"))):
            groups.setdefault(width, []).append((item, np.frombuffer(own, dtype=np.uint64)))
        index = pickle.dumps([Items(w, some, radius, percent) for w, some in groups.items()])
        return pa.table({"block": table.column("block").slice(0, 1), "index": pa.array([index], pa.binary())})

    return build


class Benchmark:
    """A benchmark as blocks of indexed items, made by Spark jobs."""

    def __init__(self, benchmark: DataFrame, radius: int, percent: int):
        self.spark = benchmark.sparkSession
        items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
        self.blocks = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_TEXT)
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(self.blocks, 1))).alias("block")
        self.items = items.distinct().select(block, "item_id", "text").mapInArrow(_shingled, "block long, item_id long, width int, hashes binary")
        if self.blocks > 1:
            self.items = tc.written(self.items, self.spark)
        # as many partitions as blocks: small ones would be joined to one task else
        self.index = self.items.repartition(max(self.blocks, 1), "block").groupBy("block").applyInArrow(_indexed(radius, percent), "block long, index binary")
        if self.blocks > 1:
            self.index = tc.written(self.index, self.spark)

    def one(self, k: int):
        """Block k as a broadcast."""
        row = self.index.where(F.col("block") == k).first()
        return self.spark.sparkContext.broadcast(pickle.loads(row["index"]) if row else [])

    def sieve(self):
        sizes = self.items.select("width", (F.octet_length("hashes") / 8).cast("long").alias("size")).distinct().collect()
        slots = self.items.mapInArrow(_slots_of, "slot long")
        chunk = F.shiftright("slot", CHUNK.bit_length() - 1).alias("chunk")
        chunks = slots.groupBy(chunk).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(CHUNK - 1)).alias("bits")).collect()
        return self.spark.sparkContext.broadcast(Sieve([tuple(c) for c in chunks], [tuple(s) for s in sizes]))

    def hits(self, docs: DataFrame, percent: int) -> DataFrame:
        """docs (row, doc_id, text), read once -> (row, doc_id, item_id ...), the best window of each row and item."""
        sieve = self.sieve()
        stretches = tc.written(docs.mapInArrow(_sift(sieve, percent), STRETCHES_SCHEMA), self.spark)
        sieve.destroy()
        out = None
        for k in range(self.blocks):
            index = self.one(k)
            part = tc.written(stretches.mapInArrow(_held_against(index, percent), ROW_HIT_SCHEMA), self.spark)
            index.destroy()
            out = part if out is None else out.union(part)
        # an item may be found in several stretches
        best = F.max(F.struct("similarity", (-F.col("start_word")).alias("start"), "distance", "n_words")).alias("best")
        return out.groupBy("row", "doc_id", "item_id").agg(best).select(
            "row", "doc_id", "item_id", (-F.col("best.start")).alias("start_word"), "best.n_words", "best.similarity", "best.distance"
        )


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> the best window of each document and item that match."""
    held = Benchmark(benchmark, radius, percent)
    if held.blocks <= 1:
        return tc.text_only(docs).mapInArrow(_scan(held.one(0), percent, None), HIT_SCHEMA)
    return held.hits(tc.text_only(docs).withColumn("row", F.monotonically_increasing_id()), percent).drop("row")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, with all their columns, that match no item."""
    held, columns = Benchmark(benchmark, radius, percent), docs.columns
    if held.blocks <= 1:
        flag = tc.fresh(columns, "contaminated")
        return docs.mapInArrow(_scan(held.one(0), percent, flag), _with(docs, flag)).where(~F.col(flag)).select(*columns)
    row = tc.fresh(columns, "row_number")
    docs = tc.written(docs.withColumn(row, F.monotonically_increasing_id()), held.spark)
    texts = docs.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dirty = held.hits(texts, percent).select(F.col("row").alias(row)).distinct()
    return docs.join(dirty, row, "left_anti").select(*columns)


def _with(df: DataFrame, flag: str) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())])


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(tc.read_table(spark, sf_dir, "documents"), tc.read_table(spark, sf_dir, "benchmark"))
