"""What executors and their Python workers keep in memory."""

import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from clauseframe.llm import language_id, toxicity
from clauseframe.llm import textcore as tc
from clauseframe.llm.ngram_join import jaccard_components
from tests.llm.conftest import sentence


def test_tasks_of_the_pipeline_load_no_pandas():
    names = ("language_id", "toxicity", "ngram_join", "decontaminate", "packing")
    code = f"import sys, {', '.join('clauseframe.llm.' + n for n in names)}; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


def test_links_are_found_without_pandas_in_the_plan(spark):
    rows = [(i, sentence(1, 100 + i % 3)) for i in range(6)]
    out = jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in out.collect()} == {0}
    schema = "u long, v long, central double, chunk long"
    chunk = spark.createDataFrame([(7, 1, 0, [1, 2, 3, 4]), (5, 1, 0, [1, 2, 3, 4]), (5, 1, 0, [1, 2, 3, 4]), (5, 1, 0, [8, 9]), (9, 1, 1, [1, 2, 3, 4, 5])], "node long, chunk long, first int, tokens array<long>")
    from clauseframe.llm.ngram_join import _local_links

    found = {tuple(r) for r in chunk.coalesce(1).groupBy("chunk").applyInArrow(_local_links(75), schema).select("u", "v", "chunk").collect()}
    assert {f for f in found if f[1] is not None} == {(5, 9, 1), (7, 9, 1)}


def test_small_tables_start_no_python_workers(spark, monkeypatch):
    rows = [(i, sentence(i, 30), "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: pytest.fail("rows in Python"))
    assert language_id.fit(docs, public_tokenizers.path(language_id.VOCABULARY), rounds=1).langs == ["de", "en"]
    assert tc.local_table(spark, {"a": tc.pa.array(["x", None]), "b": tc.pa.array([2**53 + 1, None])}).collect() == [("x", 2**53 + 1), (None, None)]


def test_reads_are_bounded_by_rows(spark, tmp_path):
    one, other = spark.newSession(), spark.newSession()
    tc.bounded_batches(one)
    assert one.conf.get(tc.READ_CONF) == str(tc.READ_ROWS)
    other.conf.set(tc.READ_CONF, "4096")
    tc.bounded_batches(other)
    assert other.conf.get(tc.READ_CONF) == "4096"
    one.range(0, 3000, 1, 1).select("id", F.lit("x").alias("text")).write.parquet(f"{tmp_path}/t")
    assert one.read.parquet(f"{tmp_path}/t").agg(F.sum("id")).first()[0] == 3000 * 2999 // 2


TEXTS = [f"often the rare{i} word{i}" for i in range(200)]


def test_languages_of_words_met_again_are_computed_once(monkeypatch):
    monkeypatch.setattr(language_id, "CACHED", 40)
    asked, log_prob = [], language_id.Pieces.log_prob
    monkeypatch.setattr(language_id.Pieces, "log_prob", lambda self, words, prob: asked.extend(words) or log_prob(self, words, prob))
    path = public_tokenizers.path(language_id.VOCABULARY)
    size = len(language_id.Pieces(path).names)
    prob = np.random.default_rng(1).dirichlet(np.ones(size), 2).T
    scorer = language_id.Scorer(language_id.Model(path, ["a", "b"], prob), True)
    got = np.concatenate([scorer.scores([t]) for t in TEXTS])
    assert asked.count("▁often") == asked.count("▁the") == 1 and len(asked) == 402
    assert len(scorer.known) <= 44 and len(scorer.table) == len(scorer.known)
    fresh = np.concatenate([language_id.Scorer(language_id.Model(path, ["a", "b"], prob), True).scores([t]) for t in TEXTS[::40]])
    assert np.array_equal(got[::40], fresh)


def test_margins_of_words_met_again_are_computed_once(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHED", 40)
    asked = []
    monkeypatch.setattr(toxicity, "word_margins", lambda model, words: asked.extend(words) or np.array([len(w) / 10 for w in words]))
    scorer = toxicity.Scorer(toxicity.Model(np.zeros(1), 0.0, None))
    got = np.concatenate([scorer.tops([t]) for t in TEXTS])
    assert asked.count("often") == asked.count("the") == 1 and len(asked) == 402 and len(scorer.known) <= 44
    assert got[-1, : toxicity.TOPS].tolist() == [0.7, 0.7, 0.5]


def test_slim_tables_go_to_few_files(spark):
    many = spark.range(0, 1000, 1, 50).repartition(50, "id")
    cores = spark.sparkContext.defaultParallelism
    got = tc.written(tc.in_few_files(many, 1000), spark)
    assert len(got.inputFiles()) <= cores and got.agg(F.sum("id")).first()[0] == 499_500
    assert cores < len(tc.written(tc.in_few_files(many, 30 * tc.SLIM_ROWS), spark).inputFiles()) <= 30
