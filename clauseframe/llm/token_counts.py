"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens that no piece of the vocabulary crosses (a run of spaces or line feeds and what
follows it). Pre-tokens not met before are laid out as ragged numpy arrays of symbols; in each round every
sequence finds its lowest-rank adjacent pair, all of them are merged at once, and a sequence without a pair is
done. What survives is counted; a character outside the vocabulary falls back to its UTF-8 bytes.

Where merging one occurrence of a pair can't give rise to a better pair, all its occurrences in a sequence are
merged in one round (left to right); otherwise only the leftmost, as the sequential algorithm would.

Edge cases: null and empty texts have 0 bytes and 0 tokens; blank texts count their space pieces; repeated rows are
counted each; very long words take more rounds but no more memory than their own length. Special strings in a
text are ordinary text. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clauseframe.llm import textcore as tc

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHED = 300_000
NONE = np.int32(2**31 - 1)
MARK = "▁"


class RankMerger:
    """The merge table of a sentencepiece BPE model, as sorted arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only models with identity normalisation, a dummy prefix and escaped spaces are supported")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == pb.ModelProto.SentencePiece.NORMAL}
        if any("\n" in p or MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece crosses the boundaries of pre-tokens")
        size = len(model.pieces)
        score = [p.score for p in model.pieces]
        order = sorted(normal.values(), key=lambda i: (-score[i], i))
        rank = {i: r for r, i in enumerate(order)}
        keys, ranks = [], []
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                a, b = normal.get(piece[:k]), normal.get(piece[k:])
                if a is not None and b is not None:
                    keys.append(a * (size + 1) + b)
                    ranks.append(rank[i])
        at = np.argsort(keys)
        self.width = size + 1
        self.keys, self.ranks = np.array(keys, dtype=np.int64)[at], np.array(ranks, dtype=np.int32)[at]
        self.piece = np.array(order, dtype=np.int32)
        self.char = np.full(0x110000, size, dtype=np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        #: By rank, whether no pair with the new piece comes before the pair that made it.
        best = np.full(size + 1, NONE, dtype=np.int32)
        for part in (self.keys // self.width, self.keys % self.width):
            np.minimum.at(best, part, self.ranks)
        self.calm = best[self.piece] > np.arange(len(order))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, pretokens: list[str]) -> np.ndarray:
        """The number of tokens of each non-empty pre-token, whose spaces are MARK."""
        lengths = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        code = np.frombuffer("".join(pretokens).encode("utf-32-le"), dtype=np.uint32)
        sym = self.char[code]
        owner = np.repeat(np.arange(len(pretokens)), lengths)
        out = np.zeros(len(pretokens), dtype=np.int64)
        odd = sym == self.width - 1
        extra = 0 + (code[odd] > 0x7F) + (code[odd] > 0x7FF) + (code[odd] > 0xFFFF)
        np.add.at(out, owner[odd], extra)
        while len(sym):
            rank = np.full(len(sym), NONE, dtype=np.int32)
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self._pairs(sym[:-1][same], sym[1:][same])
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            sizes = np.diff(np.append(heads, len(sym)))
            best = np.minimum.reduceat(rank, heads)
            done = best == NONE
            out[owner[heads[done]]] += sizes[done]
            hit = (rank == np.repeat(best, sizes)) & (rank != NONE)
            at = np.flatnonzero(hit)
            if not len(at):
                break
            new_run = np.concatenate([[True], (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])])
            run_start = np.maximum.accumulate(np.where(new_run, at, 0))
            first = np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
            at = at[((at - run_start) % 2 == 0) & (first | self.calm[rank[at]])]
            sym = sym.copy()
            sym[at] = self.piece[rank[at]]
            keep = np.repeat(~done, sizes)
            keep[at + 1] = False
            sym, owner = sym[keep], owner[keep]
        return out


_PRETOKEN = re.compile(" +[^ \n]*|\n+[^ \n]*")


class TokenCounter:
    """Counts tokens of texts; remembers a bounded number of pre-tokens."""

    def __init__(self, path: str):
        self.merger, self.known = RankMerger(path), {}

    def counts(self, texts: list[str]) -> list[int]:
        cut = [_PRETOKEN.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        new = list({p for parts in cut for p in parts if p not in known})
        if new:
            known.update(zip(new, self.merger.count([p.replace(" ", MARK) for p in new]).tolist()))
        return [sum(map(known.__getitem__, parts)) for parts in cut]


def _counter(path: str) -> TokenCounter:
    return tc.held(f"token counter {path}", lambda: TokenCounter(path))


def _rows(path: str, limit: int):
    def run(batches):
        counter = _counter(path)
        for batch in batches:
            for at, to, _, offsets in tc.text_blocks(batch.column("text")):
                texts = batch.column("text").slice(at, to - at).to_pylist()
                n = np.array(counter.counts(texts), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit), row by row and without a shuffle."""
    return tc.text_only(docs).mapInArrow(_rows(model, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(tc.read_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
