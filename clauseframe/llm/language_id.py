"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the
sum over all its segmentations into pieces, which a forward algorithm computes; a text is scored by the sum of
its words' log probabilities. The piece probabilities are fitted by expectation-maximisation over the same
sums (forward-backward), from the word counts of each language.

Learning uses a bounded sample of labelled rows: about `per_language` documents a language, by a hash
of doc_id. Word counts and expected piece counts are aggregated by Spark; what reaches the driver is the model
(the vocabulary times the languages), `TOGETHER` languages at a time.

`predict` can also hold each text against a plain model in which all pieces are alike, so that text in no known language shows.

Edge cases: null texts and texts without a letter are `und` with score 0; characters outside the vocabulary have a
small fixed probability; equal scores go to the alphabetically first language; words of any length are scored and learned from
whole, with all segmentations; rows with null lang are not learned from; repeated rows are scored each. Without any labelled row, all texts are `und`.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm import textcore as tc

VOCABULARY = "piece_bpe_32k.model"
PER_LANGUAGE = 2_000
TOGETHER = 32
ROUNDS = 3
CACHED = 100_000
CACHED_LENGTH = 64
STRETCH = 8_192
MOST_CHARACTERS = 1 << 19
UNKNOWN = math.log(1e-9)
MARK = "▁"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary as a sorted table of substring hashes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [p for p in (model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))]
        self.longest = max(map(len, self.names))
        self.begins = np.zeros(1 << 20, dtype=bool)  # by the upper bits of their hashes, all beginnings of pieces
        keys = np.empty(len(self.names), dtype=np.uint64)
        for i, piece in enumerate(self.names):
            h = 0
            for k, ch in enumerate(piece):
                h = (h * int(_PRIME) + ord(ch)) & 0xFFFFFFFFFFFFFFFF
                self.begins[(h ^ k + 1) >> 44] = True
            keys[i] = h ^ len(piece)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.arange(len(order))[order]

    def _found(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces inside words: the word's number, first character, size and piece."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths)
        at, h, stop = np.arange(len(code)), np.zeros(len(code), dtype=np.uint64), ends[row]
        got = []
        for size in range(1, self.longest + 1):
            inside = at + size <= stop
            at, h, stop = at[inside], h[inside], stop[inside]
            h = h * _PRIME + code[at + size - 1]
            key = h ^ np.uint64(size)
            open_ = self.begins[key >> np.uint64(44)]
            at, h, stop, key = at[open_], h[open_], stop[open_], key[open_]
            if not len(at):
                break
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[place] == key)
            got.append((at[hit], np.full(len(hit), size), self.ids[place[hit]]))
        at, size, piece = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, dtype=np.int64),) * 3
        return row[at], at - (ends - lengths)[row[at]], size, piece

    def _from_left(self, words: list[str], a: int, b: int):
        """Pieces that end after character a and not after b: word, end, size, piece."""
        base = max(0, a - self.longest + 1)
        row, start, size, piece = self._found([w[base:b] for w in words] if b - a < max(map(len, words)) else words)
        end = start + size + base
        keep = end > a
        return row[keep], end[keep], size[keep], piece[keep]

    def _from_right(self, words: list[str], a: int, b: int):
        """The same, with characters counted from the ends of the words."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        base = np.maximum(lengths - b, 0)
        row, start, size, piece = self._found([w[k : max(k, len(w) - a - 1 + self.longest)] for w, k in zip(words, base.tolist())])
        end = (lengths - base)[row] - start
        keep = end > a
        return row[keep], end[keep], size[keep], piece[keep]

    def _sums(self, words: list[str], side, prob: np.ndarray):
        """Yield t, x, scale: the sum over all segmentations of the first (or last) t characters is x * exp(scale), by word and language.

        Only the last `longest` sums are kept, and pieces are looked up for STRETCH characters at a time, so memory doesn't follow
        a word's length. A sum is at least 1e-9 times the one before, so that scaling once in `longest` steps is enough.
        """
        n, width, back = len(words), max(map(len, words)), self.longest
        sums = np.zeros((2 * back, n, prob.shape[1]))
        sums[back - 1] = 1
        scale = np.zeros((n, prob.shape[1]))
        stretch = -(-STRETCH // back) * back
        for a in range(0, width, stretch):
            b = min(a + stretch, width)
            row, end, size, piece = side(words, a, b)
            kind = end * (back + 1) + size
            order = np.argsort(kind, kind="stable")
            row, piece, kind = row[order], piece[order], kind[order]
            cuts = np.flatnonzero(np.diff(kind, prepend=-1))
            groups = [*zip((kind[cuts] // (back + 1)).tolist(), (kind[cuts] % (back + 1)).tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(kind)]), (0, 0, 0, 0)]
            g = 0
            for t in range(a + 1, b + 1):
                k = back + (t - 1) % back
                total = np.multiply(sums[k - 1], math.exp(UNKNOWN), out=sums[k])
                while groups[g][0] == t:
                    _, width_, lo, to = groups[g]
                    r = row[lo:to]
                    total[r] += sums[k - width_][r] * prob[piece[lo:to]]
                    g += 1
                yield t, total, scale
                if k == 2 * back - 1:
                    peak = total.copy()
                    sums[:back] = sums[back:] / peak
                    scale += np.log(peak)

    def _alike(self, words: list[str], most: int):
        """Numbers of words, those of like length together."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and to - at < most and len(words[order[to]]) <= len(words[order[at]]) + 2 and (to - at) * len(words[order[to]]) < MOST_CHARACTERS:
                to += 1
            yield order[at:to]
            at = to

    def log_prob(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """log P(word | language), summed over all segmentations; words of like length together."""
        out = np.zeros((len(words), prob.shape[1]))
        for some in self._alike(words, max(64, 65_536 // max(prob.shape[1], 8))):
            lengths, some = np.array([len(words[i]) for i in some]), np.array(some)
            first = int(lengths.min())
            for t, x, scale in self._sums([words[i] for i in some], self._from_left, prob):
                if t >= first:
                    done = np.flatnonzero(lengths == t)
                    out[some[done]] = np.log(x[done]) + scale[done]
        return out

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in words of one language, by sums from both ends. Memory: 16 bytes a character of the longest word."""
        out = np.zeros(len(self.names))
        lp = np.log(prob)
        for numbers in self._alike(words, 4096):
            some, weight = [words[i] for i in numbers], counts[numbers]
            lengths = np.array([len(w) for w in some])
            width = int(lengths.max())
            left, right = np.zeros((2, width + 1, len(some)))
            for to, side in ((left, self._from_left), (right, self._from_right)):
                for t, x, scale in self._sums(some, side, prob[:, None]):
                    to[t] = np.log(x[:, 0]) + scale[:, 0]
            whole = left[lengths, np.arange(len(some))]
            for a in range(0, width, STRETCH):
                row, end, size, piece = self._from_left(some, a, min(a + STRETCH, width))
                share = np.exp(left[end - size, row] + lp[piece] + right[lengths[row] - end, row] - whole[row])
                out += np.bincount(piece, share * weight[row], minlength=len(out))
        return out


def pieces(path: str) -> Pieces:
    return tc.held(f"pieces {path}", lambda: Pieces(path))


class Model:
    def __init__(self, path: str, langs: list[str], prob: np.ndarray):
        self.path, self.langs, self.prob, self.name = path, langs, prob.astype(np.float32), uuid.uuid4().hex


def _words(text: str) -> list[str]:
    return [MARK + w for w in text.split()]


def held_out(remainder: int, of: int):
    """Whether the hash of doc_id has that remainder; a missing doc_id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == remainder, F.lit(False))


def _expect(path: str, langs: list[str], broadcast):
    index = {x: i for i, x in enumerate(langs)}

    def run(batches):
        v, prob = pieces(path), broadcast.value
        for batch in batches:
            of, words, n = batch.column("lang").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_numpy().astype(float)
            for lang in sorted(index.keys() & set(of)):
                some = [i for i, x in enumerate(of) if x == lang]
                got = v.expected([MARK + words[i] for i in some], n[some], prob[:, index[lang]])
                ids = np.flatnonzero(got > 1e-9)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(ids)), pa.array(ids, pa.int64()), pa.array(got[ids])], ["lang", "piece", "n"])

    return run


def fit(docs: DataFrame, vocabulary: str, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """docs (doc_id, text, lang): learn from the rows with a language, at most `per_language` of each."""
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    # a threshold on the hash keeps about so many of each language; no group is gathered or sorted
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    size = len(Pieces(vocabulary).names)
    whole = np.full((size, len(langs)), 1.0 / size, dtype=np.float32)
    for at in range(0, len(langs), TOGETHER):
        some = langs[at : at + TOGETHER]  # languages are learned apart, so a few at a time give the same model
        share = F.broadcast(tc.local_table(spark, {"lang": pa.array(some, pa.string()), "share": pa.array([per_language / sizes[x] for x in some], pa.float64())}))
        sample = known.select("doc_id", "text", "lang").join(share, "lang").where("pmod(xxhash64(doc_id, 5), 1000003) < share * 1000003")
        words = sample.select("lang", F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''")
        counts = tc.written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), spark)
        prob, index = np.full((size, len(some)), 1.0 / size), {x: i for i, x in enumerate(some)}
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(prob)
            got = counts.mapInArrow(_expect(vocabulary, some, sent), "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
            sent.destroy()
            total = np.full(prob.shape, 0.01)
            total[got["piece"].to_numpy(), got["lang"].map(index).to_numpy()] += got["n"].to_numpy()
            prob = total / total.sum(axis=0)
        whole[:, at : at + len(some)] = prob
    return Model(vocabulary, langs, whole)


class Scorer:
    """Scores texts; remembers the words of one model, a bounded number of them. `plain`: with a last column for the plain model."""

    def __init__(self, model: Model, plain: bool):
        self.langs, self.pieces, self.known = model.langs, Pieces(model.path), {}
        even = np.full((len(model.prob), int(plain)), 1.0 / len(model.prob), dtype=np.float32)
        self.prob = np.hstack([model.prob, even])
        self.table = np.zeros((0, self.prob.shape[1]), dtype=np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        cut = [t.split() for t in texts]
        own = {w for words in cut for w in words}
        if len(self.known) > CACHED:  # what these texts need stays
            again = own & self.known.keys()
            self.table = self.table[np.fromiter(map(self.known.__getitem__, again), dtype=np.int64, count=len(again))]
            self.known = dict(zip(again, range(len(again))))
        known = self.known
        new = sorted(own - known.keys(), key=len)
        at, kept = len(known), sum(len(w) <= CACHED_LENGTH for w in new)
        if new:
            got = self.pieces.log_prob([MARK + w for w in new], self.prob.astype(np.float64))
            self.table = np.concatenate([self.table[:at], got.astype(np.float32)])
            known.update(zip(new, range(at, at + len(new))))
        out = np.zeros((len(texts), self.prob.shape[1]))
        for i, words in enumerate(cut):
            if words:
                out[i] = self.table[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0, dtype=np.float64)
        if kept < len(new):  # longer words are not remembered
            for w in new[kept:]:
                del known[w]
            self.table = self.table[: at + kept]
        return out


def _predict(broadcast, name: str, plain: bool, names: list[str]):
    def run(batches):
        scorer = tc.held(f"languages {name} {plain}", lambda: Scorer(broadcast.value, plain))
        langs = np.array([*scorer.langs, "und"], dtype=object)
        n = len(langs) - 1
        for batch in batches:
            preds, sures, gains = [], [], []
            for at, to, _, _ in tc.text_blocks(batch.column("text")):
                texts = [t or "" for t in batch.column("text").slice(at, to - at).to_pylist()]
                able = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool) & (n > 0)
                pick, sure, gain = np.full(len(texts), n), np.zeros(len(texts)), np.zeros(len(texts))
                if able.any():
                    total = scorer.scores([t if ok else "" for t, ok in zip(texts, able)])
                    best = total[:, :n].argmax(axis=1)
                    odds = np.exp(total[:, :n] - total[:, :n].max(axis=1, keepdims=True))
                    pick, sure = np.where(able, best, pick), np.where(able, 1 / odds.sum(axis=1), 0.0)
                    if plain:
                        gain = np.where(able, (total[:, :n].max(axis=1) - total[:, n]) / np.maximum([len(t) for t in texts], 1), 0.0)
                preds.append(langs[pick])
                sures.append(sure)
                gains.append(gain)
            join = lambda parts: np.concatenate(parts) if parts else []
            made = [pa.array(join(preds), pa.string()), pa.array(join(sures), pa.float64()), pa.array(join(gains), pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made[: len(names)]], [*batch.schema.names, *names])

    return run


def predict(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "lang_score", gain: str | None = None) -> DataFrame:
    """docs with the language and its probability, and (gain) by how much a character is likelier in it than in the plain model.

    All columns of docs stay, but for those of the given names, which are replaced.
    """
    names = [pred, score, *([gain] if gain else [])]
    taken = {c.lower() for c in names}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in taken])
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), *[T.StructField(c, T.DoubleType()) for c in names[1:]]])
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), model.name, gain is not None, names), schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tc.text_only(tc.read_table(spark, sf_dir, "documents"), "lang")
    model = fit(docs.where(~held_out(0, 5)), public_tokenizers.path(VOCABULARY))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(0, 5).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
