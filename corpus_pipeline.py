"""A corpus pipeline over `documents`: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm import decontaminate, language_id, packing, toxicity
from clauseframe.llm import textcore as tc
from clauseframe.llm.ngram_join import BROADCAST_IDS, jaccard_components

SURE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, those unsure between languages, and those that no language explains.

    A language explains a text if it makes the text likelier than a model without a language, in which all pieces are alike.
    Null, empty and blank texts go; repeated rows are judged each; an empty table, or one without any lang, keeps nothing.
    """
    tc.bounded_batches(spark)
    model = language_id.fit(docs, public_tokenizers.path(language_id.VOCABULARY))
    pred, score, gain = (tc.fresh(docs.columns, c) for c in ("lang_pred", "lang_score", "lang_gain"))
    scored = language_id.predict(docs, model, pred, score, gain)
    return scored.where((F.col(pred) != "und") & (F.col(score) >= SURE) & (F.col(gain) > 0)).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic.

    Null and empty texts have the lowest score and stay; repeated rows are scored each; without labels of both classes all stay.
    """
    tc.bounded_batches(spark)
    model, score = toxicity.fit(docs, tc.read_table(spark, sf_dir, "labels")), tc.fresh(docs.columns, "toxic_score")
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest doc_id (a missing one comes last).

    Rows are grouped by their texts alone, so rows that repeat a doc_id with another text stay; of equal rows one stays. Null
    and blank texts are no copies of anything and stay.
    """
    tc.bounded_batches(spark)
    row = tc.fresh(docs.columns, "row_number")
    docs = tc.written(docs.withColumn(row, F.monotonically_increasing_id()), spark)
    parts = jaccard_components(spark, docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    n_rows = docs.count()
    parts = tc.written(tc.in_few_files(parts, n_rows), spark)
    # rows outside groups need not be looked at again
    grouped = parts.join(parts.where("component_id <> row").select("component_id").distinct(), "component_id", "left_semi")
    named = grouped.join(docs.select(F.col(row).alias("row"), "doc_id"), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    others = tc.written(tc.in_few_files(grouped.join(first, ["component_id", "row"], "left_anti").select(F.col("row").alias(row)), n_rows), spark)
    hint = F.broadcast if others.count() <= BROADCAST_IDS else (lambda df: df)
    return docs.join(hint(others), row, "left_anti").drop(row)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    Null and blank texts hold none and stay; repeated rows are judged each; an empty benchmark keeps all.
    """
    tc.bounded_batches(spark)
    return decontaminate.without_contaminated(docs, tc.read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences: a row for each piece. Null and empty texts are one end id; other columns are left out."""
    return packing.pack(spark, docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_copies", one_of_each_group),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the language, toxicity and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tc.read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = tc.written(stage(spark, docs, sf_dir), spark)
    return docs
