"""The stages of the pipeline: what they keep, and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.conftest import sentence  # noqa: E402
from tests.llm.test_similarity import brute_components  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, margin_0 double, row_number int"


def table(spark, rows):
    """Documents with columns whose names the stages use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "kept", 1.5, 7) for i, t, lang in rows], COLUMNS)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda x: (x is None, x))


def abuse():
    bad, rows, labels = ["gromblar", "skuntel", "vexidork"], [], []
    for i in range(300):
        words = sentence(i, 60).split()
        if i % 5 == 0:
            words[10], words[40] = bad[i % 3], bad[(i // 3) % 3]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, i % 2, int(i % 5 == 0)))
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = abuse()
    rows += [(1000, rows[1][1], "en"), (1001, rows[2][1] + " and one more", "en"), (1002, "before it " + sentence(900, 40) + " after it", "en"), (1003, "", "en"), (1004, None, "en")]
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, sentence(900, 40)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_language_drops_what_no_language_explains(spark, folder):
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("qxzjkvw#%{}^~0123456789") for _ in range(rng.randint(4, 12))) for _ in range(60))
    clean = [(i, sentence(i, 50), "en") for i in range(40)]
    out = pipeline.known_language(spark, table(spark, [*clean, (50, noise, None), (51, None, None), (52, " \n", "en"), (53, "12 345 !", None), (0, clean[0][1], "en")]), folder)
    assert ids(out) == sorted([0, *range(40)]) and out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert {r["lang_pred"] for r in out.collect()} == {"kept"}


def test_toxicity_keeps_the_clean(spark, folder):
    rows, labels = abuse()
    out = pipeline.not_toxic(spark, table(spark, [*rows, (900, None, None), (901, "", None), (None, "amber basil", None)]), folder)
    kept = set(ids(out))
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & kept) <= 2 and len(kept - toxic) >= 238 and {900, 901, None} <= kept and {r["margin_0"] for r in out.collect()} == {1.5}


def test_one_of_each_group(spark, folder):
    base = sentence(1, 100)
    rows = [(5, base, None), (3, base, None), (3, base, None), (7, base.replace(base.split()[50], "other", 1), None), (1, sentence(2, 50), None), (1, sentence(3, 50), None), (None, sentence(4, 50), None), (9, sentence(4, 50), None), (11, None, None), (12, "", None), (12, "", None)]
    out = pipeline.one_of_each_group(spark, table(spark, rows), folder)
    assert ids(out) == [1, 1, 3, 9, 11, 12, 12] and "row_number" in out.columns and {r["row_number"] for r in out.collect()} == {7}
    few = [(i, t) for i, t, _ in abuse()[0][:30]] + [(100 + i, base + f" tail {i}") for i in range(5)]
    want = set(brute_components(few).values())
    assert set(ids(pipeline.one_of_each_group(spark, table(spark, [(i, t, None) for i, t in few]), folder))) == want


def test_benchmark(spark, folder):
    rows = [(1, "x " + sentence(900, 40), None), (2, sentence(5, 60), None), (3, None, None), (4, "", None), (2, sentence(5, 60), None)]
    assert ids(pipeline.without_benchmark(spark, table(spark, rows), folder)) == [2, 2, 3, 4]


def test_whole_run(spark, folder):
    out = pipeline.run(spark, folder)
    got = set(ids(out.select("doc_id").distinct()))
    toxic = {i for i in range(300) if i % 5 == 0}
    assert not got & {1000, 1001, 1002, 1003, 1004} and len(got & toxic) <= 2 and len(got - toxic) >= 238
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert used.where("n > 4096").count() == 0


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_empty_tables(spark, folder, name):
    assert dict(pipeline.STAGES)[name](spark, table(spark, []), folder).count() == 0
