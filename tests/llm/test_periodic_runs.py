"""Periodic runs against a plain search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from clauseframe.llm import periodic_runs as pr


def plain_runs(words, least, power):
    out, seen = [], set()
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, power * q) and (i, length) not in seen:  # the smallest period comes first
                seen.add((i, length))
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    """The contract, word by word."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 6, 4)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
        "collapsed_sha256": sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def ordered(rows):
    return sorted(rows, key=lambda r: (str(r["doc_id"]), r["collapsed_sha256"]))


@pytest.mark.parametrize("least, power", [(6, 4), (1, 2), (4, 3), (10, 5)])
def test_runs_equal_a_plain_search(least, power):
    rng = random.Random(least)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
            words = [rng.randint(0, letters) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                words = [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]
            texts.append(words)
        at = np.cumsum([0] + [len(w) for w in texts])
        found = pr.runs_of_words(np.array([x for w in texts for x in w], dtype=np.int64), at, least, power)
        assert [tuple(r) for r in found.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in plain_runs(w, least, power)]


def test_long_periods_and_long_runs():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 3000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    rng = np.random.default_rng(1)
    unit = rng.integers(0, 50, 700).tolist()
    for words in (fibonacci[-1], [7] * 2500, unit * 4, unit * 3 + unit[:699], [1, 2] * 600 + [1] + [1, 2] * 500):
        found = pr.runs_of_words(np.array(words), np.array([0, len(words)]))
        assert [tuple(r[1:]) for r in found.tolist()] == plain_runs(words, 6, 4)


def test_power_below_two_is_refused():
    with pytest.raises(ValueError):
        pr.runs_of_words(np.array([1, 1]), np.array([0, 2]), power=1)


def test_operator_returns_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, " x a b\ta b a\x0bb a b y", 3), (2, "a a a a a", 3), (3, "Ab ab " * 9, 3)], "doc_id long, text string, runs int")
    rows = {r["doc_id"]: r for r in pr.periodic_runs(docs).collect()}
    assert [tuple(x) for x in rows[1]["runs"]] == [(1, 8, 2)] and rows[1]["collapsed"] == "x a b y"
    assert rows[2]["runs"] == [] and rows[2]["collapsed"] == "a a a a a"  # five words are too few
    assert [tuple(x) for x in rows[3]["runs"]] == [(0, 18, 2)] and rows[3]["collapsed"] == "Ab ab"


def test_query_equals_the_contract(spark, docs, texts):
    """Null, empty, blank, short, long, repeated and odd texts, null ids, and columns of other names."""
    more = [(i, " ".join(str(k % (2 + i % 7)) for k in range(i))) for i in range(100, 160)]
    both = docs.select("doc_id", "text", "source").union(spark.createDataFrame([(*r, "s") for r in more], "doc_id long, text string, source string"))
    got = [r.asDict() for r in pr.digests(pr.periodic_runs(pr.with_planted_ends(both))).collect()]
    assert ordered(got) == ordered(plain_row(*r) for r in [*texts, *more])
    assert sum(r["n_runs"] > 0 for r in got) > 30


def test_query_over_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = [r.asDict() for r in pr.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()]
    assert ordered(got) == ordered(plain_row(*r) for r in table)


def test_no_rows(spark, none):
    assert pr.digests(pr.periodic_runs(pr.with_planted_ends(none))).collect() == []
