"""The pipeline on DataFrames of documents. Every step stays in its row; nothing is shuffled, so batch and streams share it.

Null or blank texts, and documents on which a step fails, give an `error` and no fragments; other columns of the input pass through analyse_documents and
split_documents unless their names clash with those made here, which are replaced.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseframe.functions import catalog as C
from clauseframe.functions.ordinals import get_ordinal
from clauseframe.functions.sql import apart
from clauseframe.functions.text import clean_html, count_paragraphs
from clauseframe.operators import fragments as fr
from clauseframe.operators import groups, levels, markers, mask, qualify
from clauseframe.operators.score import checked_scores, score_udf

MISSING, EMPTY, TOO_MANY = "未获取到文本", "text is empty", "too many fragments"
FAILED = "document could not be processed"
MAX_FRAGMENTS = 10_000


def with_markers(docs: DataFrame, text: str = "text", clean: bool = True, extra: markers.Guard | None = None) -> DataFrame:
    """Adds clean_text, masked, markers (guarded, without overlaps; null for a text on which they fail) and marker_error."""
    raw = F.col(text).cast("string")
    docs = docs.withColumn("clean_text", clean_html(raw) if clean else raw)
    docs = docs.withColumn("masked", apart(mask.mask(F.col("clean_text"))))
    docs = docs.withColumn("found", markers.found_spans(F.col("masked"), extra=extra))
    return docs.withColumn("markers", markers.without_overlaps(markers.ordered(F.col("found.spans")))).withColumn("marker_error", F.col("found.error")).drop("found")


def analyse_documents(docs: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """Adds entries (statistics by type), reasons (suppressions), report and split_types to with_markers."""
    docs = with_markers(docs, text, clean).withColumn("entries", groups.entries(F.col("markers")))
    docs = docs.withColumn("reasons", groups.suppressions(F.col("entries")))
    docs = docs.withColumn("report", qualify.report(F.col("clean_text"), F.col("entries"), F.col("reasons")))
    return docs.withColumn("split_types", qualify.split_types(F.col("report")))


def score_documents(docs: DataFrame, text: str = "text", clean: bool = True) -> DataFrame:
    """The other classifier: by the scores of numbered markers. Adds scores, spine_type, satellite_type, all_tags and counts."""
    docs = docs.withColumn("clean_text", clean_html(F.col(text).cast("string")) if clean else F.col(text).cast("string"))
    docs = docs.withColumn("masked", apart(mask.mask(F.col("clean_text"))))
    docs = docs.withColumn("markers", markers.without_overlaps(markers.raw_markers(F.col("masked"), C.SCORED)))
    docs = docs.withColumn("scores", apart(F.col("markers.ord"))).withColumn("scores", score_udf("scores"))
    kept = F.transform(F.filter(F.arrays_zip("markers", "scores"), lambda x: x["scores"]["kept"]), lambda x: x["markers"]["type"])
    docs = docs.withColumn("kept_types", kept).withColumn("all_tags", F.array_distinct("kept_types"))
    counted = lambda names: F.transform(names, lambda t: F.struct(F.size(F.filter(F.col("kept_types"), lambda x: x == t)).alias("n"), (-F.array_position(F.col("all_tags"), t)).alias("first"), t.alias("type")))
    dots = F.array(F.lit("数字点"), F.lit("数字点点"))
    best = lambda names: F.array_max(counted(names))
    docs = docs.withColumn("spine", best(F.array_intersect("all_tags", dots))).withColumn("satellite", best(F.array_except("all_tags", dots)))
    lines = F.size(F.split("clean_text", "\n", -1))
    return docs.select("*", F.col("spine.type").alias("spine_type"), F.col("satellite.type").alias("satellite_type"), F.coalesce("spine.n", F.lit(0)).alias("max_n"), F.coalesce("satellite.n", F.lit(0)).alias("max_gc"), lines.alias("para_count")).drop("spine", "satellite", "kept_types")


def split_documents(docs: DataFrame, text: str = "text", clean: bool = True, max_fragments: int | None = None) -> DataFrame:
    """Adds to analyse_documents: scores, levels, fragments (with levels and ordinals), meta and error.

    A document with more than max_fragments gives an error and no fragments.
    """
    docs = analyse_documents(docs, text, clean)
    docs = docs.withColumn("candidates", fr.candidates(F.col("markers"), F.col("split_types")))
    docs = docs.withColumn("scores", apart(fr.scored_ordinals(F.col("candidates")))).withColumn("checked", checked_scores("scores"))
    docs = docs.withColumn("scores", F.col("checked.rows")).withColumn("score_error", F.col("checked.error"))
    docs = docs.withColumn("decided", fr.decided(F.col("candidates"), F.col("scores")))
    paragraph_mode = F.array_contains("split_types", F.lit(C.PLAIN_PARAGRAPHS))
    none = F.expr(f"cast(array() as array<{fr.FRAGMENT}>)")
    blank = F.coalesce(F.col("clean_text"), F.lit("")) == ""
    docs = docs.withColumn("cut", F.when(blank | F.col("scores").isNull(), none).when(paragraph_mode, fr.by_paragraphs(F.col("clean_text"))).otherwise(fr.cut(F.col("clean_text"), F.col("decided"))))
    docs = docs.withColumn("levels", apart(F.col("cut.split_type"))).withColumn("checked", levels.checked_levels("levels")).withColumn("levels", F.col("checked.rows"))
    level = lambda t: F.filter(F.col("levels"), lambda x: x["type"] == t)
    docs = docs.withColumn("fragments", F.transform("cut", lambda f: f.withField("index_level", F.get(level(f["split_type"]), F.lit(0))["level"]).withField("ordinal", get_ordinal(f["content"]))))
    failed = F.col("markers").isNull() | F.col("scores").isNull() | F.col("levels").isNull()
    error = F.when(F.col(text).isNull(), MISSING).when(blank, EMPTY).when(failed, F.concat_ws(": ", F.lit(FAILED), F.coalesce("marker_error", "score_error", "checked.error")))
    if max_fragments is not None:
        over = F.size("cut") > max_fragments
        error = error.when(over, TOO_MANY)
        docs = docs.withColumn("fragments", F.when(~over, F.col("fragments")).otherwise(F.slice("fragments", 1, 0)))
    docs = docs.withColumn("error", error)
    meta = F.struct(F.length(F.col(text).cast("string")).alias("raw_char_count"), F.length("clean_text").alias("char_count"), F.size("cut").alias("fragment_count"), F.col("split_types").alias("all_tags"), levels.level_chain(F.col("levels")).alias("level_chain"))
    return docs.withColumn("meta", meta).drop("candidates", "decided", "cut", "checked", "marker_error", "score_error")


def fragments_table(split: DataFrame, id_col: str = "law_id") -> DataFrame:
    """A row for each fragment."""
    return split.select(id_col, F.explode("fragments").alias("f")).select(id_col, "f.*")


def split_by_ids(ids: DataFrame, source: DataFrame, id_col: str = "law_id", text: str = "text", parts: int | None = None, every: bool = False) -> DataFrame:
    """Each id with its text split, or an error: repeated ids in `ids` are kept, of repeated ids in `source` one text is taken, or with `every` all.

    The source is cut down to the asked ids before its texts move, and they move once: to the parts in which they are split. Splitting
    costs far more than reading, so there are `parts` of them (by default four for each core, or the shuffle partitions
    if more), whatever the bytes.
    """
    spark = ids.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    asked = ids.groupBy(id_col).agg(F.count("*").alias("times"))
    texts = source.select(id_col, text).join(asked.select(id_col), id_col, "left_semi").repartition(parts, id_col)
    first = Window.partitionBy(id_col).orderBy(F.xxhash64(text), text)
    one = texts if every else texts.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    found = asked.repartition(parts, id_col).join(one.hint("merge"), id_col, "left")
    split = split_documents(found, text)
    # an id that is asked for again is not split again
    return split.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def tool_result(split: DataFrame, id_col: str = "law_id") -> DataFrame:
    """(id, result): the fragments and meta of each document as JSON."""
    shown = F.transform("fragments", lambda f: F.struct(f["seq"], f["content"], f["split_type"], f["index_level"], f["ordinal"], f["extra"]))
    return split.select(id_col, F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.to_json(F.struct(shown.alias("fragments"), "meta"))).alias("result"))


def split_text(spark: SparkSession, text: str | None, max_fragments: int | None = MAX_FRAGMENTS) -> dict:
    """One text, as a call: its fragments and meta with the time taken, or an error. For many texts use split_documents."""
    began = time.monotonic()
    row = split_documents(spark.createDataFrame([(text,)], "text string"), max_fragments=max_fragments).select("fragments", "meta", "error").first().asDict(recursive=True)
    if row["error"]:
        return {"error": row["error"]}
    shown = [{k: v for k, v in f.items() if k not in ("start", "end")} for f in row["fragments"]]
    return {"fragments": shown, "meta": row["meta"] | {"processing_ms": round(1000 * (time.monotonic() - began))}}


def document_report(split: DataFrame, id_col: str = "law_id") -> DataFrame:
    """One flat row for each document."""
    join = lambda c: F.array_join(c, ", ")
    return split.select(id_col, F.col("meta.raw_char_count").alias("raw_char_count"), F.col("meta.char_count").alias("char_count"), join("report.spine_types").alias("spine_types"), "report.max_n", join("report.satellite_types").alias("satellite_types"), "report.max_gc", join("report.all_tags").alias("all_tags"), join("split_types").alias("split_types"), F.col("meta.fragment_count").alias("fragment_count"), "report.para_count", "error")


def type_report(analysed: DataFrame, id_col: str = "law_id") -> DataFrame:
    """A row for each type that a document has: counts, groups, first ordinals, why it is suppressed, and its part in the structure."""
    docs = analysed.withColumn("q", qualify.qualified(F.col("entries"), F.col("reasons")))
    near_n, near_gc = qualify.near_misses(F.col("q"))
    rows = docs.select(id_col, "report", "reasons", near_n.alias("near_n"), near_gc.alias("near_gc"), F.posexplode("entries").alias("i", "e")).where("e.count > 0")
    among = lambda c: F.array_contains(c, F.col("e.type"))
    part = F.when(among(F.col("report.spine_types")), "spine").when(among(F.col("report.satellite_types")), "satellite").when(among(F.col("near_n")), "near spine").when(among(F.col("near_gc")), "near satellite")
    return rows.select(id_col, "e.type", "e.count", "e.group_count", "e.max_n", groups.first_ordinals(F.col("e")).alias("ordinals"), F.array_join(groups.group_labels(F.col("e")), ", ").alias("group_labels"), F.expr("get(reasons, i)").alias("reason"), part.alias("part"))


def fragment_rollup(split: DataFrame, by: str = "lang", id_col: str = "law_id") -> DataFrame:
    """Fragments, documents and characters by class, type and level, with totals; `grouping` tells a total from a missing value."""
    rows = split.select(id_col, by, F.explode("fragments").alias("f")).select(id_col, by, "f.split_type", "f.index_level", F.length("f.content").alias("size"))
    sets = [[by, "split_type", "index_level"], [by, "split_type"], ["split_type", "index_level"], [by], []]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], by, "split_type", "index_level")
    return grouped.agg(F.grouping_id().alias("grouping"), F.count("*").alias("fragments"), F.countDistinct(id_col).alias("documents"), F.sum("size").alias("characters"))


def level_report(split: DataFrame, id_col: str = "law_id", deepest: int = 5) -> DataFrame:
    """One row for each document, the types of each level side by side."""
    at = lambda k: F.array_join(F.sort_array(F.transform(F.filter("levels", lambda x: x["level"] == k), lambda x: x["type"])), ", ")
    depth = F.coalesce(F.array_max(F.transform("levels", lambda x: x["level"])) + 1, F.lit(0))
    return split.select(id_col, F.col("meta.fragment_count").alias("fragment_count"), *[at(k).alias(f"level_{k}") for k in range(deepest + 1)], depth.alias("levels_n"), levels.level_bars(F.col("levels")).alias("level_chain"))


def resume(todo: DataFrame, done: DataFrame, id_col: str = "law_id") -> DataFrame:
    """The documents that are not done yet."""
    return todo.join(done.select(id_col).distinct(), id_col, "left_anti")


def paragraph_counts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(id_col, count_paragraphs(F.col(text)).alias("para_count"))


def error_rows(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without and with an error."""
    return split.where("error IS NULL"), split.where("error IS NOT NULL")


