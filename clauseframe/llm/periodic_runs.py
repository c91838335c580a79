"""Periodic runs of words by partition refinement.

Places of a text are classed by the word that begins there, then by two words, three, and so on. From one length to
the next only the small parts of the classes that were just divided are looked at (the largest part of each keeps its
class), so a place is moved a logarithmic number of times. Neighbours of a class whose distance equals the length stand
before a square; squares at consecutive places are one run. All texts of a block are refined together.

A run of at least `power` periods leaves at least `power - 1` members in each class that shows it, so smaller classes
are given up at once, and lengths beyond a `power`-th of a text are not looked at.

Edge cases: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows give equal
rows; a null doc_id is kept. Memory follows the longest text of a batch. Other columns are left out.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.functions.sql import let, raw
from clauseframe.llm import textcore as tc

LEAST, POWER = 6, 4
BLOCK = 8 << 20
#: Up to this length all places are looked at for squares; beyond it, those that are due by their distance.
DENSE = 16
RUN = "struct<start:long,length:long,period:long>"
WORD = r"[^\x20\x09-\x0D]+"


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    return np.arange(int(counts.sum())) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _heads(x: np.ndarray) -> np.ndarray:
    """Where a stretch of equal values begins."""
    new = np.empty(len(x), dtype=bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new.nonzero()[0]


def _sizes(heads: np.ndarray, n: int) -> np.ndarray:
    """How long the stretches are that begin at heads and end at n."""
    out = np.empty(len(heads), dtype=np.int64)
    out[-1:] = n
    out[:-1] = heads[1:]
    return out - heads


class _Classes:
    """Places by equal factors, each class in order of place."""

    def __init__(self, key: np.ndarray, members: int):
        n = len(key)
        self.members, self.n = members, n
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        heads = _heads(key[self.order])
        self.count = len(heads)
        self.first, self.size = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32)
        self.first[: self.count] = heads
        self.size[: self.count] = _sizes(heads, n)
        self.of, self.slot = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
        self.of[self.order] = np.repeat(np.arange(self.count), self.size[: self.count])
        self.slot[self.order] = np.arange(n)
        self.next, self.before = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        self._link(self.order, self.of[self.order])
        self.marked = np.zeros(n, dtype=bool)

    def _link(self, places: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Make neighbours of consecutive places of a group; those of too small groups get none. Returns the linked ones."""
        same = (group[1:] == group[:-1]) & (self.size[group[1:]] >= self.members)
        self.next[places], self.before[places] = -1, -1
        self.next[places[:-1][same]] = places[1:][same]
        self.before[places[1:][same]] = places[:-1][same]
        return places[:-1][same]

    def refine(self, small: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Divide the classes of the places before `small` (ascending) by the classes of `small`.

        Returns the places of all new classes, ascending, and those whose neighbour changed.
        """
        none = small[:0]
        small = small[(small > 0) & (last[small] >= length)]
        small = small[self.size[self.of[small - 1]] >= self.members]
        if not len(small):
            return none, none
        key = self.of[small - 1].astype(np.int64) * (self.n + 1) + self.of[small]
        at = np.argsort(key, kind="stable")
        key, places = key[at], small[at] - 1
        heads = _heads(key)
        sizes = _sizes(heads, len(key))
        owner = key[heads] // (self.n + 1)
        tops = _heads(owner)
        kth = np.repeat(np.arange(len(tops)), _sizes(tops, len(owner)))
        rest = self.size[owner[tops]] - np.add.reduceat(sizes, tops)
        biggest = np.maximum.reduceat(sizes, tops)
        # the largest part keeps the class: what is left of it, or else the first of the largest groups
        stays = np.zeros(len(sizes), dtype=bool)
        largest = ((sizes == biggest[kth]) & (rest < biggest)[kth]).nonzero()[0]
        stays[largest[_heads(kth[largest])]] = True
        go = np.repeat(~stays, sizes)
        moved, group, held = places[go], np.repeat(np.arange(len(sizes)), sizes)[go], np.repeat(owner, sizes)[go]
        left = ((rest < biggest) & (rest > 0)).nonzero()[0]
        if len(left):
            c = owner[tops[left]]
            own = self.order[_spread(self.first[c], self.size[c])]
            self.marked[places] = True
            free = ~self.marked[own]
            self.marked[places] = False
            whose = np.repeat(np.arange(len(c)), self.size[c])[free]
            own = own[free]
            by = np.lexsort((own, whose))
            moved, group, held = np.concatenate([moved, own[by]]), np.concatenate([group, len(sizes) + whose[by]]), np.concatenate([held, c[whose[by]]])
            by = np.argsort(held, kind="stable")
            moved, group, held = moved[by], group[by], held[by]
        if not len(moved):
            return none, none
        return self._move(moved, group, held)

    def _move(self, moved: np.ndarray, group: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Make classes of groups of places; they lie by class, group and place."""
        heads = _heads(held)
        counts, owner = _sizes(heads, len(held)), held[heads]
        # neighbours that stay close up over those that go
        by = np.lexsort((moved, held))
        gone = moved[by]
        begin = np.ones(len(gone) + 1, dtype=bool)
        np.not_equal(self.before[gone[1:]], gone[:-1], out=begin[1:-1])
        a, b = self.before[gone[begin[:-1]]], self.next[gone[begin[1:]]]
        self.next[a[a >= 0]], self.before[b[b >= 0]] = b[a >= 0], a[b >= 0]
        changed = a[(a >= 0) & (b >= 0)]
        # those that go take the end of the class's stretch
        tail = self.first[owner] + self.size[owner] - counts
        slots = _spread(tail, counts)
        there = self.order[slots]
        self.marked[moved] = True
        out = there[~self.marked[there]]
        self.marked[moved] = False
        freed = self.slot[moved[self.slot[moved] < np.repeat(tail, counts)]]
        self.order[freed], self.slot[out] = out, freed
        self.order[slots], self.slot[moved] = moved, slots
        self.size[owner] -= counts
        cut = _heads(group)
        names = self.count + np.arange(len(cut))
        self.count += len(cut)
        self.first[names], self.size[names] = slots[cut], _sizes(cut, len(group))
        self.of[moved] = np.repeat(names, self.size[names])
        linked = self._link(moved, self.of[moved])
        small = owner[self.size[owner] < self.members]
        if len(small):
            dead = self.order[_spread(self.first[small], self.size[small])]
            self.next[dead], self.before[dead] = -1, -1
        return np.sort(moved), np.concatenate([changed, linked])


class _Due:
    """Places by the distance to their neighbour, so that each length looks only at its own."""

    def __init__(self, classes: _Classes, last: np.ndarray):
        self.classes, self.last, self.until = classes, last, DENSE
        self.sorted, self.gaps, self.late = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), defaultdict(list)

    def _between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        gap = self.classes.next - np.arange(self.classes.n)
        places = np.flatnonzero((gap >= low) & (gap <= np.minimum(self.last, high)))
        by = np.argsort(gap[places], kind="stable")
        return places[by], gap[places[by]]

    def at(self, length: int, changed: np.ndarray) -> np.ndarray:
        """The places whose neighbour is as far as the length; `changed` since the last call."""
        c = self.classes
        if length <= DENSE:
            return self._between(length, length)[0]
        if length > self.until:
            self.until = 2 * length
            self.sorted, self.gaps = self._between(length, self.until)
            self.late.clear()
        else:
            gaps = c.next[changed] - changed
            soon = (gaps >= length) & (gaps <= self.until)
            for g, p in zip(gaps[soon].tolist(), changed[soon].tolist()):
                self.late[g].append(p)
        lo, hi = np.searchsorted(self.gaps, [length, length + 1])
        found = self.sorted[lo:hi]
        if length in self.late:
            found = np.unique(np.concatenate([found, self.late.pop(length)])).astype(np.int64)
        return found[(c.next[found] - found == length) & (self.last[found] >= length)]

    def after(self, length: int) -> list[tuple[int, np.ndarray]]:
        """All greater distances, when classes don't change any more."""
        places, gaps = self._between(length + 1, self.classes.n)
        cut = _heads(gaps)
        return list(zip(gaps[cut].tolist(), np.split(places, cut[1:])))


def runs_of_words(words: np.ndarray, at: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period of all maximal runs with at least `power` periods and `least` words.

    words: numbers of the words of all texts, those of text k from at[k] to at[k + 1].
    """
    n = np.diff(at)
    none = np.empty((0, 4), dtype=np.int64)
    if power < 2:
        raise ValueError(f"a run has at least 2 periods, not {power}")
    if not len(words) or n.max() < max(least, power):
        return none
    # every text ends with a mark of its own
    text = np.repeat(np.arange(len(n)), n + 1)
    begins = at[:-1] + np.arange(len(n))
    last = (n // power).astype(np.int32)[text]
    key = np.full(len(text), -1, dtype=np.int64)
    real = np.ones(len(text), dtype=bool)
    real[at[1:] + np.arange(len(n))] = False
    key[real] = words
    key += 1 + text * (int(words.max()) + 2)
    classes = _Classes(key, max(2, power - 1))
    due = _Due(classes, last)
    found = []

    def squares(period: int, places: np.ndarray) -> None:
        if not len(places):
            return
        cut = _heads(places - np.arange(len(places)))
        length = _sizes(cut, len(places)) - 1 + 2 * period
        long = length >= max(least, power * period)
        if long.any():
            start = places[cut[long]]
            found.append(np.stack([text[start], start - begins[text[start]], length[long], np.full(len(start), period)], axis=1))

    squares(1, due.at(1, classes.order))
    small = np.arange(classes.n)
    for length in range(2, int(last.max()) + 1):
        small, changed = classes.refine(small, last, length)
        if not len(small):
            for period, places in due.after(length - 1):
                squares(period, places)
            break
        squares(length, due.at(length, changed))
    if not found:
        return none
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _kept(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that stand in no run after its first period."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def _rows(least: int, power: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.large_binary())
            for lo, hi, _, _ in tc.text_blocks(batch.column("text"), BLOCK):
                split = [(t or b"").split() for t in texts.slice(lo, hi - lo).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
                known: dict[bytes, int] = {}
                words = np.fromiter((known.setdefault(w, len(known)) for s in split for w in s), dtype=np.int64, count=int(at[-1]))
                rows = runs_of_words(words, at, least, power)
                cut = np.searchsorted(rows[:, 0], np.arange(len(split) + 1))
                collapsed = [_kept(s, rows[a:b]) if a < b else b" ".join(s) for s, a, b in zip(split, cut[:-1], cut[1:])]
                parts = [pa.array(rows[:, k]) for k in (1, 2, 3)]
                runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, runs by start and period, collapsed), row by row and without a shuffle.

    A run is a maximal stretch of at least `least` words with at least `power` of its smallest periods. The collapsed text
    has the words, joined by one space, that stand in no run after the first period of it.
    """
    return tc.text_only(docs).mapInArrow(_rows(least, power), f"doc_id long, runs array<{RUN}>, collapsed string")


def with_planted_ends(docs: DataFrame) -> DataFrame:
    """The text of every tenth document, by a hash of its doc_id, with an end that repeats: from word a on, the same p words."""
    begin = let("named_struct('a', g % size(w), 'g', g)", "s", let("named_struct('a', s.a, 'p', 1 + (size(w) - s.a) div (3 + s.g % 8))", "e", "array_join(transform(w, (x, i) -> if(i < e.a, x, w[int(e.a + (i - e.a) % e.p)])), ' ')"))
    planted = let(f"regexp_extract_all(text, {raw(WORD)}, 0)", "w", f"if(size(w) = 0, text, {let('crc32(string(doc_id)) div 10', 'g', begin)})")
    return tc.text_only(docs).withColumn("text", F.expr(f"CASE WHEN text IS NOT NULL AND crc32(string(doc_id)) % 10 = 0 THEN {planted} ELSE text END"))


def digests(found: DataFrame) -> DataFrame:
    """Of periodic_runs, a row for each document: the number of runs, the longest one, and hashes of all and of the collapsed text."""
    longest = "array_max(transform(runs, r -> named_struct('length', r.length, 'first', -r.start, 'small', -r.period)))"
    lines = "array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')"
    out = found.withColumn("best", F.expr(longest))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.expr("-best.first").alias("start"),
        F.col("best.length").alias("length"),
        F.expr("-best.small").alias("period"),
        F.expr("1000 * best.length div -best.small").alias("exponent_milli"),
        F.expr(f"sha2({lines}, 256)").alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted_ends(tc.read_table(spark, sf_dir, "documents"))))
