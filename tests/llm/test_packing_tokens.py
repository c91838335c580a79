"""Packing, token counts, token shards and sharding against the libraries and against plain loops."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clauseframe.llm import packing, sharding, token_counts, token_shards, word_ids
from clauseframe.llm.word_ids import WordIds

PATH = public_tokenizers.path


def expected_ids(texts):
    tokenizer = Tokenizer.from_file(PATH(packing.TOKENIZER))
    return [np.array([*e.ids, packing.END], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_word_ids_equal_the_library():
    odd = ["", "It's I'LL \t<|endoftext|>x", "é É ﬁ ǅ ² ½ İstanbul ΣΑΣ", "a\x1cb\x85c\xa0d　e", "x́ 日本 😀", "_a_b 12,5!"]
    ids = WordIds(PATH(packing.TOKENIZER))
    assert [np.frombuffer(ids.ids(t), "<u4").tolist() for t in odd] == [x[:-1].tolist() for x in expected_ids(odd)]


def test_words_met_again_are_cut_once(monkeypatch):
    monkeypatch.setattr(word_ids, "CACHED", 40)
    cut, part = [], WordIds._part
    monkeypatch.setattr(WordIds, "_part", lambda self, x: cut.append(x) or part(self, x))
    ids = WordIds(PATH(packing.TOKENIZER))
    texts = [f"Often the, rare{'abcdefghij'[i % 10] * (1 + i // 10)} it's {'long' * 20}{i}." for i in range(300)]
    assert [np.frombuffer(ids.ids(t), "<u4").tolist() for t in texts] == [x[:-1].tolist() for x in expected_ids(texts)]
    assert cut.count("often") == cut.count("the") == cut.count(",") == 1
    # the cache is bounded in words and in their length
    assert len(ids.known) + len(ids.known.last) <= 80 and max(map(len, ids.known)) <= word_ids.LONG


def test_packing_covers_every_id_once(spark, docs, texts):
    rows = packing.pack(spark, docs.repartition(3), PATH(packing.TOKENIZER), length=256, open_windows=4).collect()
    whole = defaultdict(list)
    for (doc, _), ids in zip(texts, expected_ids([t for _, t in texts])):
        whole[doc].append(ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in whole[r["doc_id"]])
    assert {d: sum(map(len, x)) for d, x in whole.items()} == {d: sum(r["length"] for r in x) for d, x in pieces.items()}
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256 and at & (at - 1) == 0  # no padding at all


def test_token_counts_equal_the_library(docs, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH(token_counts.MODEL))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, PATH(token_counts.MODEL)).collect())
    want = []
    for i, t in texts:
        n = len(model.encode(t or ""))
        want.append((-1 if i is None else i, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want)


@pytest.mark.parametrize("text", ["   ", "a  b", "\n\n x\n", "<s> </s> <unk>", "a▁b ▁▁c", " " * 300, "abcabcaaaaaaa" * 50, "\tnul\x00"])
def test_odd_token_counts(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH(token_counts.MODEL))
    assert token_counts.TokenCounter(PATH(token_counts.MODEL)).counts([text]) == [len(model.encode(text))]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation(n):
    assert sorted(token_shards.permuted(np.arange(n), n)) == list(range(n))
    assert n < 10 or (token_shards.permuted(np.arange(n), n, 1) != token_shards.permuted(np.arange(n), n, 2)).any()


def test_shards_hold_every_sequence_at_its_slot(spark, docs, texts, tmp_path):
    shards = token_shards.materialise(spark, docs.coalesce(1), PATH(token_shards.RANKS), length=64, per_shard=8)
    rows = sorted(shards.collect(), key=lambda r: r["shard_id"])
    tokenizer = Tokenizer.from_file(PATH("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = [i for _, t in texts for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, token_shards.END]]
    assert sum(r["n_tokens"] for r in rows) == len(ids)
    n = -(-len(ids) // 64)
    stream = np.array(ids + [token_shards.END] * (n * 64 - len(ids))).reshape(n, 64)
    stored = np.frombuffer(b"".join(r["payload"] for r in rows), "<u2").reshape(-1, 64)
    assert (stored[token_shards.permuted(np.arange(n), n)] == stream).all()
    for _ in range(2):  # a second run leaves what is there
        files = token_shards.write_shards(shards, f"file://{tmp_path}/out").collect()
    for first, count in ((0, n), (5, 7), (n - 3, 3), (8, 8), (3, 0)):  # a reader goes on anywhere
        got = sorted(token_shards.read_from(spark, f"file://{tmp_path}/out", first, count, 64, 8).collect())
        assert [r["slot"] for r in got] == list(range(first, first + count))
        assert all(r["ids"] == stored[r["slot"]].tolist() for r in got)
    with pytest.raises(Exception, match="shard"):
        token_shards.read_from(spark, f"file://{tmp_path}/out", n - 1, 9, 64, 8).collect()
    assert [r["first_slot"] for r in rows] == list(range(0, n, 8)) and all(r["n_sequences"] == min(8, n - r["first_slot"]) for r in rows)
    assert len(files) == len(rows) and (tmp_path / "out/shard-000000000.bin").read_bytes() == rows[0]["payload"]


def test_sharding_fits_and_equals_sql(spark, docs, texts, tmp_path):
    limit = 6000
    rows = sharding.shard(spark, docs, limit).collect()
    assert len(rows) == len(texts)
    held = defaultdict(list)
    for r in rows:
        held[r["shard_id"], r["overflow_part"]].append(r["n_bytes"])
    assert all(sum(x) <= limit or len(x) == 1 for x in held.values())
    con = duckdb.connect()
    docs.write.parquet(str(tmp_path / "d"))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(sharding.SQL.replace(str(sharding.SHARD_BYTES), str(limit))).fetchall()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key(tuple(r)) for r in rows) == sorted(map(key, want))


def test_hot_key_overflows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "SHORT", 2)
    rows = [(1, "x" * 100)] * 500 + [(1, "y" * (7 * k)) for k in range(60)] + [(1, "z" * 1500), (1, "z" * 1500), (3, "long" * 900), (None, "n" * 2000), (None, None)] + [(i, "y" * 100) for i in range(4, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df.write.parquet(str(tmp_path / "d"))
    got = sharding.shard(spark, df, 1000).collect()
    held = defaultdict(list)
    for r in got:
        held[r["shard_id"], r["overflow_part"]].append(r["n_bytes"])
    assert len(got) == len(rows) and all(sum(x) <= 1000 or len(x) == 1 for x in held.values())
    # one row over the limit leaves the others together
    assert len([k for k in held if k[1]]) < 150
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(sharding.SQL.replace(str(sharding.SHARD_BYTES), "1000")).fetchall()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(key(tuple(r)) for r in got) == sorted(map(key, want))


def test_empty_tables(spark, none):
    assert packing.pack(spark, none, PATH(packing.TOKENIZER)).count() == 0
    assert token_counts.count_tokens(none, PATH(token_counts.MODEL)).count() == 0
    assert token_shards.materialise(spark, none, PATH(token_shards.RANKS)).count() == 0
    assert sharding.shard(spark, none).count() == 0


def test_packing_keeps_ids_that_doubles_cannot_hold(spark):
    rows = [(2**53 + 1, "one two"), (2**53 + 3, "three four five"), (None, "six"), (-(2**62) - 1, None)]
    got = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH(packing.TOKENIZER)).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in rows} and all(r["length"] > 0 for r in got)


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('amber basil ', 1000) AS text")
    packing.pack(spark, docs.limit(1), PATH(packing.TOKENIZER))
    got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 36_000_000 and max(got) < 2 * packing.tc.BATCH_BYTES
