"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words sums, over all common subsequences of three characters (word ends count as characters), decay **
(span in one word + span in the other), for spans of at most `SPAN`, and is normalised to 1 for equal words. Gaps
lower a subsequence's weight instead of losing it, so insults with inserted or missing characters stay
close to the plain ones. Nystroem landmarks turn the kernel into a few hundred features, on which a linear machine
with squared hinge loss is trained. As the trained machine is linear in the landmarks' kernel values, it is stored as one
weight for each subsequence, and a word costs the same whatever the number of landmarks.

A text is a bag of words: its highest margins and length, through a logistic curve, give the score. Runs of single characters
are also read as one word. Characters other than Latin letters and digits share the kernel's symbols with these, by a hash.

Learning uses a bounded sample of the labelled rows (about `per_class` of each class, by a hash of doc_id), with near copies
taken once (the one with the smallest doc_id). It begins with words that the labels tell apart, by counts that Spark makes. Toxic rows
that no telling word explains are counted again by pairs of neighbouring words, so that an insult of two harmless words is learned as
one. Against the telling words stands a working set of clean ones: it begins with `start` of them, and in each round all clean words of the
sample are held against the machine in tasks, and those within its margin join; so no word of the sample is left out.
Then the machine is trained on the labelled sentences as bags of words: every sentence counts once, by its word of the highest
margin under the machine before, for `SENTENCE_ROUNDS` rounds; toxic sentences without a word of positive margin tell nothing and wait.

Edge cases: null and empty texts have the lowest margins; words over `WINDOW` characters are read in overlapping
windows, whole; repeated rows are scored each; without labels of both classes every score is 0.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm import textcore as tc

PER_CLASS = 3_000
LANDMARKS = 256
START = 4_000
EDGE = -1.0  # the machine's margin: clean words above it join the working set
BEGINNINGS = (4, 5, 6)
PAIRED = 2  # letters of both words that make a pair worth reading
ROUNDS, SENTENCE_ROUNDS = 4, 2
RIDGE = 1e-5
TOPS = 3
SPAN, DECAY = 7, 0.7
WINDOW = 24
CACHED = 100_000
THRESHOLD = 0.3
FLOOR = -1.0

_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789àáâãäåæçèéêëìíîïñòóôõöùúûüß"
_SYMBOLS = 61
_CODE = 3 + (np.arange(0x110000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % _SYMBOLS
for _i, _c in enumerate(_LETTERS[:_SYMBOLS]):
    _CODE[ord(_c)] = _i + 3
_CODE = _CODE.astype(np.int8)
_END = 2
_SPELLED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words, with their ends, as padded rows of character codes, and their lengths."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    flat = _CODE[flat]
    out = np.zeros((len(words), int(lengths.max()) + 3), dtype=np.int32)
    out[:, :2] = _END  # two marks, as beginnings tell most
    place = np.arange(out.shape[1])
    out[(place >= 2) & (place <= lengths[:, None] + 1)] = flat
    out[np.arange(len(words)), lengths + 2] = _END
    return out, lengths + 3


def _subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """By word, the codes of all its subsequences (0: none) and their weights."""
    code, _ = _codes(words)
    keys, weights = [], []
    for a, b in _STEPS:
        if b < code.shape[1]:
            n = code.shape[1] - b
            last = code[:, b:]
            keys.append(np.where(last > 0, (code[:, :n] * 64 + code[:, a : a + n]) * 64 + last, 0))
            weights.append(np.full(n, DECAY ** (b + 1), dtype=np.float32))
    return np.concatenate(keys, axis=1), np.concatenate(weights)


def _norms(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The square root of each word's kernel with itself."""
    order = np.argsort(keys, axis=1)
    k = np.take_along_axis(keys, order, axis=1)
    w = np.where(k > 0, weights[order], 0).astype(np.float64)
    total = np.cumsum(w, axis=1)
    last = np.ones(k.shape, dtype=bool)
    last[:, :-1] = k[:, 1:] != k[:, :-1]
    out = np.zeros(len(k))
    rows, at = np.nonzero(last)
    ends = total[rows, at]
    new = np.concatenate([[True], rows[1:] != rows[:-1]])
    size = ends - np.where(new, 0, np.concatenate([[0], ends[:-1]]))
    np.add.at(out, rows, size**2)
    return np.sqrt(np.maximum(out, 1e-12))


class Kernel:
    """Kernel values of words against a list of landmarks."""

    def __init__(self, landmarks: list[str]):
        keys, weights = _subsequences(landmarks)
        self.norms = _norms(keys, weights)
        used = np.unique(keys[keys > 0])
        self.slot = np.zeros(64**3, dtype=np.int32)
        self.slot[used] = np.arange(1, len(used) + 1)
        self.used = used
        self.table = np.zeros((len(used) + 1, len(landmarks)))
        for j in range(len(landmarks)):
            np.add.at(self.table[:, j], self.slot[keys[j]], weights)
        self.table[0] = 0
        self.table /= self.norms

    def values(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]))
        for at in range(0, len(words), 256):
            keys, weights = _subsequences(words[at : at + 256])
            norms = _norms(keys, weights)
            got = self.slot[keys]
            for i in range(len(keys)):
                hit = np.flatnonzero(got[i])
                out[at + i] = weights[hit] @ self.table[got[i, hit]] / norms[i]
        return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Squared hinge loss with a ridge, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        xs, cs = x[inside], weight[inside]
        new = np.linalg.solve((xs * cs[:, None]).T @ xs + ridge * np.eye(x.shape[1]), (xs * (cs * y[inside])[:, None]).sum(axis=0))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1]), x.T @ (y - p) - 0.05 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """The machine, the curve from margins to scores, and the beginnings of pairs of words that are read as one."""

    def __init__(self, weights: np.ndarray | None, bias: float, curve: np.ndarray | None, pairs: frozenset[tuple[str, str]] = frozenset()):
        self.weights, self.bias, self.curve, self.pairs, self.name = weights, bias, curve, pairs, uuid.uuid4().hex


def _windows(word: str) -> list[str]:
    """A word's letters and digits, in overlapping windows if they are many."""
    word = word if word.isalnum() else "".join(filter(str.isalnum, word))
    return [word] if len(word) <= WINDOW else [word[k : k + WINDOW] for k in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def word_margins(model: Model, words: list[str]) -> np.ndarray:
    """Each word's margin, FLOOR at least; norms only where the margin can be above it."""
    parts, owner = [], []
    for i, word in enumerate(words):
        for part in _windows(word):
            parts.append(part)
            owner.append(i)
    out = np.full(len(words), FLOOR)
    owner, order = np.array(owner, dtype=np.int64), np.argsort([len(p) for p in parts], kind="stable")
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        keys, weights = _subsequences([parts[i] for i in some])
        sums = model.weights[keys] @ weights
        least = np.sqrt(np.maximum((keys > 0) @ weights**2, 1e-12))
        able = np.flatnonzero(np.maximum(sums, 0) / least + model.bias > FLOOR)
        if len(able):
            got = sums[able] / _norms(keys[able], weights) + model.bias
            np.maximum.at(out, owner[some[able]], got)
    return out


def _words(text: str, pairs: frozenset[tuple[str, str]] = frozenset()) -> list[str]:
    text = text.lower()
    words = text.split()
    out = words + [m.replace(" ", "") for m in _SPELLED.findall(text)]
    if pairs:
        plain = [w if w.isalnum() else "".join(filter(str.isalnum, w)) for w in words]
        out += [a + b for a, b in zip(plain, plain[1:]) if (a[:PAIRED], b[:PAIRED]) in pairs]
    return out


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def tops(self, texts: list[str]) -> np.ndarray:
        """The highest margins of each text's words, and the logarithm of their number."""
        cut = [_words(t, self.model.pairs) for t in texts]
        own = {w for words in cut for w in words}
        if len(self.known) > CACHED:  # what these texts need stays
            self.known = {w: self.known[w] for w in own & self.known.keys()}
        known = self.known
        new = list(own - known.keys())
        if new:
            known.update(zip(new, word_margins(self.model, new).tolist()))
        out = np.full((len(texts), TOPS + 1), FLOOR)
        for i, words in enumerate(cut):
            out[i, TOPS] = math.log1p(len(words))
            if words:
                got = list(map(known.__getitem__, words))
                if max(got) > FLOOR:
                    best = heapq.nlargest(TOPS, got)
                    out[i, : len(best)] = best
        return out


def _tops(broadcast, name: str, column: str):
    def run(batches):
        scorer = tc.held(f"toxicity {name}", lambda: Scorer(broadcast.value))
        for batch in batches:
            got = [np.zeros((0, TOPS + 1))]
            for at, to, _, _ in tc.text_blocks(batch.column("text")):
                texts = [t or "" for t in batch.column("text").slice(at, to - at).to_pylist()]
                got.append(scorer.tops(texts))
            got = np.concatenate(got)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, TOPS + 1, dtype=np.int32)), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], [*batch.schema.names, column])

    return run


def margins(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """docs with an array: the highest margins of each text, and the logarithm of its number of words."""
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(_tops(docs.sparkSession.sparkContext.broadcast(model), model.name, column), schema)


def witnesses(sentences: DataFrame, model: Model) -> DataFrame:
    """(text, toxic) -> (toxic, word, margin): the word, or window of one, with the highest margin in each sentence that has any above FLOOR."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                parts = sorted({w for word in _words(text or "", shared.value.pairs) for w in _windows(word) if w})
                if parts:
                    got = word_margins(shared.value, parts)
                    best = int(got.argmax())
                    if got[best] > FLOOR:
                        rows.append((toxic, parts[best], float(got[best])))
            toxic, word, margin = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(word, pa.string()), pa.array(margin, pa.float64())], ["toxic", "word", "margin"])

    return sentences.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, word string, margin double")


def unsettled(words: DataFrame, model: Model) -> DataFrame:
    """(word) -> the words with a margin above EDGE."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            above = word_margins(shared.value, batch.column("word").to_pylist()) > EDGE
            yield batch.filter(pa.array(above))

    return words.select("word").mapInArrow(run, "word string")


def plain_words() -> Column:
    """The words of a text in lower case, without what is no letter or digit."""
    return F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\s]", ""), r"\s+")


def _pairs(bags: DataFrame) -> DataFrame:
    """The neighbouring words of each row, once each."""
    both = "transform(sequence(1, size(plain) - 1), i -> struct(plain[i - 1] AS a, plain[i] AS b))"
    plain = bags.withColumn("plain", F.filter(plain_words(), lambda w: w != ""))
    return plain.where("size(plain) > 1").select(F.explode(F.array_distinct(F.expr(both))).alias("pair")).select("pair.*")


def _telling_pairs(bags: DataFrame, likely: DataFrame, chance: float) -> DataFrame:
    """(a, b): neighbours that chance would hardly put into toxic rows alone, among those rows that hold no likely word."""
    toxic = bags.where("toxic = 1")
    told = toxic.select("row", F.explode("words").alias("word")).join(likely, "word", "left_semi").select("row").distinct()
    rare = math.log(1 / chance)
    often = _pairs(toxic.join(told, "row", "left_anti")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("pos")).where(F.col("pos") * rare > math.log(1e6))
    clean = _pairs(bags.where("toxic = 0")).join(often, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("neg"))
    surprise = (F.col("pos") - 2 * F.coalesce("neg", F.lit(0))) * rare
    return often.join(clean, ["a", "b"], "left").where(surprise > math.log(1e6)).select("a", "b")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, landmarks: int = LANDMARKS, start: int = START) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): learn from a bounded sample of the labelled rows.

    The bounds are per_class labelled rows of each class, and landmarks of the kernel. start is the size of the first working set of
    clean words, which grows by all those that the machine doesn't settle.
    """
    import pandas as pd  # for the driver alone

    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return Model(None, FLOOR, None)
    share = F.when(F.col("toxic") == 1, per_class / counts[1]).otherwise(per_class / counts[0])
    chosen = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1000003)) < share * 1000003)
    # the hash chooses about 2 * per_class ids, so they are few enough to be broadcast
    if chosen.count() > 4 * per_class + 1000:
        raise ValueError("far more labelled rows were chosen than per_class allows")
    sample = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    bags = sample.select("doc_id", "text", "toxic", plain_words().alias("words"))
    for seed in (1, 2):  # near copies, which mostly share their least run of three words, count once
        runs = f"transform(sequence(1, greatest(size(words) - 2, 1)), i -> xxhash64(slice(words, i, 3), {seed}))"
        first = F.min_by(F.struct("doc_id", "text", "toxic", "words"), F.struct("doc_id", "text"))
        bags = bags.groupBy(F.expr(f"array_min({runs})").alias("key")).agg(first.alias("one")).select("one.*")
    # long words in the windows that scoring reads them in
    cut = f"transform(words, w -> if(length(w) <= {WINDOW}, array(w), transform(sequence(1, length(w) - {WINDOW // 2}, {WINDOW // 2}), i -> substr(w, i, {WINDOW}))))"
    bags = bags.withColumn("words", F.expr(f"array_distinct(flatten({cut}))"))
    bags = tc.written(bags.withColumn("row", F.monotonically_increasing_id()), spark)
    n = {r["toxic"]: r["count"] for r in bags.groupBy("toxic").count().collect()}
    if not (n.get(0) and n.get(1)):
        return Model(None, FLOOR, None)
    words = bags.select("toxic", F.explode("words").alias("word")).where("word <> ''")
    table = tc.written(words.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), spark)
    # a word, or a beginning that many words share, is telling if chance would hardly put it into toxic rows alone
    heads = F.array_distinct(F.flatten(F.transform("words", lambda w: F.array(*[F.left(w, F.lit(k)) for k in BEGINNINGS], w))))
    units = bags.select("toxic", F.explode(heads).alias("unit")).where("unit <> ''")
    units = units.groupBy("unit").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    chance = n[1] / (n[0] + n[1])
    surprise = F.col("pos") * math.log(1 / chance) - F.col("neg") * math.log(1 / chance) * 2
    telling = units.where(surprise > math.log(1e6)).select("unit", surprise.alias("surprise"))
    own = F.array(*[F.left("word", F.lit(k)) for k in BEGINNINGS], F.col("word"))
    named = table.where("pos > neg").select("word", F.explode(F.array_distinct(own)).alias("unit")).join(telling, "unit")
    named = tc.written(named.groupBy("word").agg(F.max_by("unit", F.struct("surprise", "unit")).alias("unit")), spark)
    pairs = _telling_pairs(bags, named, chance).toPandas()
    begins = sorted({(a[:PAIRED], b[:PAIRED]) for a, b in zip(pairs["a"], pairs["b"])})
    # words of clean rows that share a telling beginning are left out, as neither kind
    heads = F.explode(F.expr("transform(sequence(1, length(word)), k -> left(word, k))"))
    alike = table.where("pos < neg").select("word", heads.alias("unit")).join(named.select("unit"), "unit", "left_semi").select("word").distinct()
    pool = table.where("pos < neg").join(alike, "word", "left_anti").select("word", "neg")
    if begins:  # neighbours in clean rows that will be read as one word
        near = tc.local_table(spark, {"a2": pa.array([a for a, _ in begins], pa.string()), "b2": pa.array([b for _, b in begins], pa.string())})
        joined = _pairs(bags.where("toxic = 0")).join(near, F.expr(f"left(a, {PAIRED}) = a2 AND left(b, {PAIRED}) = b2"), "left_semi")
        pool = pool.union(joined.groupBy(F.concat("a", "b")).agg(F.count(F.lit(1)).alias("neg")))
    pool = tc.written(pool, spark)
    often = pool.orderBy(F.desc("neg"), "word").limit(start // 2).toPandas()["word"]
    other = pool.orderBy(F.xxhash64("word", F.lit(3)), "word").limit(start // 2).toPandas()["word"]
    negative = list(dict.fromkeys([*often, *other]))
    likely = named.toPandas().sort_values(["unit", "word"])
    likely = pd.concat([likely, pd.DataFrame({"word": pairs["a"] + pairs["b"], "unit": pairs["a"] + " " + pairs["b"]})])
    if likely.empty or not negative:
        return Model(None, FLOOR, None)
    # each telling beginning counts alike, however many words have it
    likely["turn"] = likely.groupby("unit").cumcount()
    likely = likely.sort_values(["turn", "unit"])
    positive, support = likely["word"].tolist(), 1 / likely.groupby("unit")["word"].transform("count").to_numpy(dtype=float)
    chosen_marks = positive[: landmarks // 2] + negative[: landmarks // 2]
    kernel = Kernel(chosen_marks)
    square = kernel.values(chosen_marks)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    xp, xn = kernel.values(positive) @ root, kernel.values(negative) @ root

    def trained(w: np.ndarray) -> Model:
        weights = np.zeros(64**3, dtype=np.float32)
        weights[kernel.used] = kernel.table[1:] @ (root @ w[:-1])
        return Model(weights, float(w[-1]), np.zeros(TOPS + 2), frozenset(begins))

    good = np.ones(len(positive), dtype=bool)
    for k in range(ROUNDS):
        x = np.vstack([xp[good], xn])
        y = np.concatenate([np.ones(good.sum()), -np.ones(len(xn))])
        weight = np.concatenate([support[good] / support[good].sum(), np.full(len(xn), 1.0 / len(xn))])
        w = _machine(x, y, weight, RIDGE)
        now = xp @ w[:-1] + w[-1] > 0  # words that merely stand beside insults are given up
        if now.any():
            good = now
        model = trained(w)
        if k + 1 < ROUNDS:  # the clean words that are not settled yet are learned too
            more = sorted(set(unsettled(pool, model).toPandas()["word"]).difference(negative))
            if more:
                negative += more
                xn = np.vstack([xn, kernel.values(more) @ root])
    for _ in range(SENTENCE_ROUNDS):  # one word for each labelled sentence: the rows are as many as the sample's
        told = witnesses(bags, model).where("toxic = 0 OR margin > 0").toPandas().sort_values(["toxic", "word"])
        if told["toxic"].nunique() < 2:
            break
        xs, ys = kernel.values(told["word"].tolist()) @ root, np.where(told["toxic"] == 1, 1.0, -1.0)
        share = np.where(ys > 0, 1 / (ys > 0).sum(), 1 / (ys < 0).sum())
        w = _machine(np.vstack([xs, x]), np.concatenate([ys, y]), np.concatenate([share, weight]), RIDGE)
        model = trained(w)
    seen = margins(bags.select("text", "toxic"), model, "tops").select("toxic", "tops").toPandas()
    # the classes keep the shares that they have among all labels
    curve = _logistic(np.vstack(seen["tops"]), seen["toxic"].to_numpy(dtype=float))
    return Model(model.weights, model.bias, curve, model.pairs)


def score(docs: DataFrame, model: Model, column: str = "toxic_score") -> DataFrame:
    """docs with a score (0 to 1); all columns of docs stay, but for one of that name, which is replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == column.lower()])
    if model.weights is None:
        return docs.withColumn(column, F.lit(0.0))
    tops = tc.fresh([*docs.columns, column], "tops")
    x = F.lit(float(model.curve[-1]))
    for k, a in enumerate(model.curve[:-1]):
        x = x + F.lit(float(a)) * F.col(tops)[k]
    return margins(docs, model, tops).withColumn(column, 1 / (1 + F.exp(-x))).drop(tops)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clauseframe.llm.language_id import held_out

    docs = tc.text_only(tc.read_table(spark, sf_dir, "documents"))
    model = fit(docs.where(~held_out(2, 4)), tc.read_table(spark, sf_dir, "labels").where(~held_out(2, 4)))
    out = score(docs, model)
    return out.select("doc_id", held_out(2, 4).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
