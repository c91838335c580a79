"""Queries of the operators on markers as rows; importing this module registers them beside the others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseframe.functions.ordinals import int_to_cn
from clauseframe.functions.sql import apart
from clauseframe.functions.stored import shared_folder
from clauseframe.operators import markers, relations, table_function
from clauseframe.plans import api
from clauseframe.plans.queries import _LEVELS, _LINES, _ORDER, _WHOLE, ORACLE_SQL, QUERIES, _articles, _lines, _nested_docs, _spread, _texts, query
from clauseframe.sources import tables, workbook

__all__ = ["ORACLE_SQL", "QUERIES"]

#: The spans r (key, lo, hi, p) of which, in order of lo, p and length, the first of those that overlap stays.
_GREEDY = """, g AS (SELECT key, list({'lo': lo, 'hi': hi, 'at': 0::BIGINT, 'kept': [[lo]][:0]} ORDER BY lo, p, lo - hi) AS v FROM r GROUP BY key),
f AS (SELECT key, list_reduce(list_prepend({'lo': NULL, 'hi': NULL, 'at': 0::BIGINT, 'kept': []}, v), lambda a, x: CASE WHEN x.lo >= a.at THEN {'lo': a.lo, 'hi': a.hi, 'at': x.hi, 'kept': list_append(a.kept, [x.lo, x.hi])} ELSE a END).kept AS kept FROM g)"""


@query(
    "WITH r AS (SELECT l_suppkey AS key, (l_partkey * 7 + l_orderkey) % 4000 AS lo, (l_partkey * 7 + l_orderkey) % 4000 + 1 + l_quantity::BIGINT % 13 AS hi, 0 AS p FROM lineitem)"
    + _GREEDY
    + " SELECT key AS law_id, k[1] AS start, k[2] AS \"end\" FROM (SELECT key, unnest(kept) AS k FROM f)"
)
def disjoint_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a supplier's lines, of which many overlap: the greedy choice by clusters and doubled pointers."""
    start = F.expr("(l_partkey * 7 + l_orderkey) % 4000")
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("law_id"), start.alias("start"), (start + 1 + F.expr("bigint(l_quantity) % 13")).alias("end"), F.lit(0).alias("prio"), F.lit(0).alias("seq"))
    return relations.disjoint(rows.withColumn("less", F.col("start") - F.col("end")), ["law_id"]).select("law_id", "start", "end")


@query(
    f"""WITH{_LINES}, t AS (SELECT law_id, rn, '第' || rn || '.1条 一要素' || rn || '：甲' || l_partkey AS line FROM x),
b AS (SELECT law_id, rn, length(rn::VARCHAR) AS w, coalesce(sum(length(line) + 1) OVER (PARTITION BY law_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS z FROM t),
r AS (SELECT law_id AS key, z AS lo, z + w + 4 AS hi, 2 AS p FROM b UNION ALL SELECT law_id, z + 1, z + w + 3, 1 FROM b UNION ALL SELECT law_id, z + w + 5, z + w + 7, 2 FROM b UNION ALL SELECT law_id, z + w + 6, z + 2 * w + 9, 2 FROM b)"""
    + _GREEDY
    + " SELECT key AS law_id, k[1]::INT AS start, k[2]::INT AS \"end\" FROM (SELECT key, unnest(kept) AS k FROM f)"
)
def markers_without_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which 3.1 stands in 第3.1条 and 要素3： begins in 一要: all raw markers as rows, and those that stay."""
    docs = _texts(_lines(spark, sf_dir), F.concat(F.lit("第"), "rn", F.lit(".1条 一要素"), "rn", F.lit("：甲"), "l_partkey"))
    found = markers.marker_rows(_spread(docs), guard=False)
    return relations.disjoint(found.select("law_id", *relations.ORDER), ["law_id"]).select("law_id", "start", "end")


#: The markers of the nested texts with brackets, their places, and the lengths of the texts.
_PARTS = f"""WITH{_LINES}, parts AS (
 SELECT law_id, rn, 0 AS k, 0 AS level, '章' AS type, '第' || substr('一二三四五六七八九', ((rn + 1) // 2)::INT, 1) || '章' AS marker, ' 总则' AS rest FROM x WHERE rn % 2 = 1
 UNION ALL SELECT law_id, rn, 1, 1, '节', '第一节', ' 分则' FROM x WHERE rn = 1
 UNION ALL SELECT law_id, rn, 2, 2, '条', '第' || cn || '条', ' 货物' || l_partkey || '。' FROM x
 UNION ALL SELECT law_id, rn, 2 + j, 3, '括号', '（' || substr('一二三', j::INT, 1) || '）', '甲' || l_partkey || '。' FROM x, range(1, 4) t(j)),
placed AS (SELECT *, coalesce(sum(length(marker) + length(rest) + 1) OVER (PARTITION BY law_id ORDER BY rn, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM parts),
ends AS (SELECT law_id, (sum(length(marker) + length(rest) + 1) - 1)::INT AS n FROM parts GROUP BY law_id),
spans AS (SELECT p.law_id, type AS span_type, start AS lo, lead(start, 1, n) OVER (PARTITION BY p.law_id, type ORDER BY start) AS hi FROM placed p JOIN ends USING (law_id))"""


def _nested_markers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _spread(_nested_docs(spark, sf_dir, "括号"))
    return markers.marker_rows(docs), docs.select("law_id", F.length("text").alias("n"))


@query(_PARTS + " SELECT p.law_id, p.type, p.start, span_type, lo, hi FROM placed p JOIN spans s ON p.law_id = s.law_id AND p.type <> span_type AND p.start >= lo AND p.start < hi")
def markers_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every marker with all spans of other types that hold it."""
    found, lengths = _nested_markers(spark, sf_dir)
    spans = relations.type_spans(found, lengths, ["law_id"])
    return relations.holding(found.select("law_id", "type", "start"), spans, ["law_id"]).where("type <> span_type").select("law_id", "type", "start", "span_type", "lo", "hi")


@query(
    _PARTS
    + """, held AS (SELECT p.law_id, p.type, span_type, count(*) AS inside FROM placed p JOIN spans s ON p.law_id = s.law_id AND p.type <> span_type AND p.start >= lo AND p.start < hi GROUP BY ALL)
SELECT h.*, n, 2 * inside > n AS most FROM held h JOIN (SELECT law_id, type, count(*) AS n FROM placed GROUP BY ALL) c USING (law_id, type)"""
)
def span_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts from which types are suppressed: how many of a type's markers stand in spans of another."""
    return relations.inside_shares(*_nested_markers(spark, sf_dir), ["law_id"]).select("law_id", "type", "span_type", "inside", "n", F.expr("2 * inside > n").alias("most"))


@query(
    _PARTS
    + """ SELECT p.law_id, p.start, p.marker AS text, concat_ws('/', CASE WHEN level > 0 THEN '第' || substr('一二三四五六七八九', ((p.rn + 1) // 2)::INT, 1) || '章' END, CASE WHEN level > 1 AND p.rn <= 2 THEN '第一节' END, CASE WHEN level = 3 THEN '第' || cn || '条' END) AS path
FROM placed p JOIN x ON x.law_id = p.law_id AND x.rn = p.rn"""
)
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each marker with the chapter, section and article that it stands under; a new chapter ends the section."""
    found, _ = _nested_markers(spark, sf_dir)
    level = F.expr("CASE type WHEN '章' THEN 0 WHEN '节' THEN 1 WHEN '条' THEN 2 WHEN '括号' THEN 3 END")
    out = relations.governing(found.withColumn("level", level), ["law_id"], 3)
    return out.select("law_id", "start", "text", F.array_join("path", "/").alias("path"))


@query(
    "WITH RECURSIVE q AS (SELECT user_id AS law_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS type FROM events), "
    "c AS (SELECT x.law_id, x.type AS outer_type, y.type AS inner_type, count(*) AS n FROM (SELECT law_id, type, pos, lead(pos) OVER (PARTITION BY law_id, type ORDER BY pos) AS nxt, count(*) OVER (PARTITION BY law_id, type) AS k FROM q) x"
    " JOIN q y ON x.law_id = y.law_id AND x.type <> y.type AND y.pos > x.pos AND (y.pos < x.nxt OR x.k = 1) GROUP BY ALL)" + _LEVELS
)
def cyclic_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the types of event that a user mixes: hierarchies with cycles, for all users at once."""
    rows = tables.table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return relations.level_chains(relations.level_rows(rows.select(F.col("user_id").alias("law_id"), pos.alias("pos"), F.col("event_type").alias("type"))))


def _sql_strength(a: str, b: str) -> str:
    return f"""CASE WHEN {b} IS NULL OR {a} IS NULL OR {a} = {b} THEN 0 WHEN len({a}) = len({b}) AND {a}[1:len({a}) - 1] = {b}[1:len({b}) - 1] AND {b}[-1] = {a}[-1] + 1 THEN 3 WHEN {b} = list_append({a}, 1) THEN 2.5
 WHEN len({a}) = len({b}) + 1 AND {b}[1:len({b}) - 1] = {a}[1:len({a}) - 2] AND {b}[-1] = {a}[-2] + 1 THEN 2 WHEN len({a}) >= 3 AND len({b}) = 1 AND {b}[1] = {a}[1] + 1 THEN 1.5 ELSE 0 END"""


def _sql_neighbours() -> str:
    less = lambda a, b: f"CASE WHEN len({a}) <> len({b}) THEN len({a}) < len({b}) ELSE {a}[-1] < {b}[-1] END"
    terms = ["CASE WHEN list_contains(o, 0) THEN -5 ELSE 0 END"]
    for n, weight in ((1, 1), (2, 0.6)):
        for other, up in ((f"l{n}", less(f"l{n}", "o")), (f"r{n}", less("o", f"r{n}"))):
            terms.append(f"{weight} * ({_sql_strength('o', other)}) * CASE WHEN {up} THEN 1 ELSE -1 END")
            terms.append(f"{weight / 2} * ({_sql_strength(other, 'o')}) * CASE WHEN {up} THEN 1 ELSE 0 END")
    return " + ".join(terms)


_ORD = "CASE l_suppkey % 3 WHEN 0 THEN {a}l_linenumber{b} WHEN 1 THEN {a}l_linenumber, {q} % 3{b} ELSE {a}l_linenumber, 1, {q} % 3{b} END"


@query(
    f"""WITH o AS (SELECT l_orderkey AS law_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, {_ORDER}) - 1 AS pos, {_ORD.format(a="[", b="]::BIGINT[]", q="l_quantity::BIGINT")} AS o FROM lineitem),
n AS (SELECT *, lag(o, 1) OVER w AS l1, lag(o, 2) OVER w AS l2, lead(o, 1) OVER w AS r1, lead(o, 2) OVER w AS r2 FROM o WINDOW w AS (PARTITION BY law_id ORDER BY pos))
SELECT law_id, pos, round({_sql_neighbours()}, 6)::DOUBLE AS score FROM n"""
)
def neighbour_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two steps of scoring ordinals, by windows."""
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", *_ORDER.split(", "))
    ords = F.expr(f"transform({_ORD.format(a='array(', b=')', q='bigint(l_quantity)')}, x -> bigint(x))")
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("law_id"), (F.row_number().over(w) - 1).cast("long").alias("pos"), ords.alias("ord"))
    return relations.neighbour_scores(rows, ["law_id"]).select("law_id", "pos", F.round("score", 6).alias("score"))


@query(
    f"""WITH o AS (SELECT l_suppkey AS law_id, l_returnflag AS type, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, {_ORDER}) AS place, l_linenumber AS n FROM lineitem),
s AS (SELECT *, max(CASE WHEN n = 1 THEN place END) OVER (PARTITION BY law_id, type ORDER BY place) AS first FROM o WHERE type IN ('A', 'N')),
h AS (SELECT law_id, type, first, list_reduce(list(n::BIGINT ORDER BY place), lambda a, x: CASE WHEN x = a + 1 THEN x ELSE a END) AS hi FROM s WHERE first IS NOT NULL GROUP BY ALL)
SELECT law_id, type, row_number() OVER (PARTITION BY law_id, type ORDER BY first)::INT AS group_no, hi, first, CASE WHEN hi >= 3 THEN 'stay' ELSE 'suppressed' END AS tag FROM h WHERE hi >= 2"""
)
def group_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a supplier's line numbers, for two of three return flags: each group is kept or suppressed by itself."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", *_ORDER.split(", "))
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("law_id"), F.col("l_returnflag").alias("type"), F.row_number().over(w).cast("long").alias("start"), F.col("l_linenumber").alias("n"))
    return relations.group_marks(rows, ["law_id"], ("A", "N")).select("law_id", "type", "group_no", "hi", "first", "tag")


@query(
    f"""WITH d AS (SELECT l_orderkey AS law_id, count(*) AS n, (count(*) + 1) // 2 AS c FROM lineitem GROUP BY 1),
s(law_id, type, count, lo, n, groups) AS (SELECT law_id, '条', n, n, n, 1 FROM d UNION ALL SELECT law_id, '章', c, c, c, 1 FROM d UNION ALL SELECT law_id, '节', 1, 1, 0, 0 FROM d UNION ALL SELECT law_id, '括号', 3 * n, 3, 3, n FROM d),
t AS (SELECT s.law_id, s.type, s.count, CASE WHEN lo >= 2 THEN groups ELSE 0 END AS group_count, CASE WHEN lo >= 2 THEN lo ELSE 0 END AS max_n, CASE WHEN s.type = '条' AND d.n IN (3, 4) THEN '条包裹抑制(括号)' END AS reason,
  array_to_string([CASE WHEN s.type = '括号' THEN 1 + (i - 1) % 3 ELSE i END FOR i IN range(1, least(8, s.count) + 1)], ', ') || CASE WHEN s.count > 8 THEN ' (+' || (s.count - 8) || ')' ELSE '' END AS ordinals,
  CASE WHEN lo >= 2 THEN array_to_string(['1-' || lo FOR i IN range(groups)], ', ') ELSE '' END AS group_labels FROM s JOIN d USING (law_id)),
q AS (SELECT *, reason IS NULL AND count >= 3 AND (group_count >= 2 OR group_count >= 1 AND max_n >= 3) AS ok FROM t),
m AS (SELECT law_id, max(max_n) FILTER (ok) AS n, max(group_count) FILTER (ok) AS gc FROM q GROUP BY law_id)
SELECT law_id, type, count::INT AS count, group_count::INT AS group_count, max_n::INT AS max_n, ordinals, group_labels, reason,
 CASE WHEN NOT ok THEN NULL WHEN max_n = n THEN 'spine' WHEN group_count = gc THEN 'satellite' WHEN max_n >= n - 1 THEN 'near spine' WHEN group_count >= gc - 1 THEN 'near satellite' END AS part FROM q JOIN m USING (law_id)"""
)
def type_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each type of a nested text has: counts, groups, ordinals, suppression, and its part in the structure."""
    return api.type_report(api.analyse_documents(_spread(_nested_docs(spark, sf_dir, "括号"))))


@query(_PARTS + " SELECT law_id, string_agg(type, ',' ORDER BY start) AS types FROM placed WHERE type <> '节' GROUP BY law_id")
def type_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw order of chosen types in each text, from which a batch analysis infers levels."""
    docs = _spread(_nested_docs(spark, sf_dir, "括号")).withColumn("text", apart(F.col("text")))
    return docs.select("law_id", F.array_join(markers.type_sequence(F.col("text"), ["章", "条", "括号"]), ",").alias("types"))


@query(
    """WITH v AS (SELECT 's' || l_suppkey AS law_id, l_linenumber::BIGINT AS n FROM lineitem UNION ALL SELECT l_returnflag || l_linestatus, l_orderkey FROM lineitem UNION ALL SELECT 'p' || l_linenumber, l_partkey - 3 FROM lineitem),
d AS (SELECT DISTINCT law_id, n FROM v), r AS (SELECT law_id, n, row_number() OVER (PARTITION BY law_id ORDER BY n) AS k FROM d WHERE n >= 1)
SELECT law_id, CASE WHEN coalesce(max(r.n) FILTER (r.n = k), 0) >= 2 THEN max(r.n) FILTER (r.n = k) ELSE 0 END::BIGINT AS max_n FROM (SELECT DISTINCT law_id FROM v) a LEFT JOIN r USING (law_id) GROUP BY law_id"""
)
def bitmap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest 1..N of each key, few keys having most rows, from merged bitmaps."""
    rows = tables.table(spark, sf_dir, "lineitem")
    numbers = rows.selectExpr("'s' || l_suppkey AS law_id", "bigint(l_linenumber) AS n").union(rows.selectExpr("l_returnflag || l_linestatus", "l_orderkey")).union(rows.selectExpr("'p' || l_linenumber", "l_partkey - 3"))
    return relations.longest_runs(numbers, ["law_id"])


@query(_PARTS + " SELECT p.law_id, start, start + length(marker)::INT AS \"end\", p.type, marker AS text, (CASE type WHEN '章' THEN (p.rn + 1) // 2 WHEN '节' THEN 1 WHEN '条' THEN p.rn ELSE k - 2 END)::BIGINT AS ord FROM placed p")
def lateral_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markers of all nested texts by SQL, with the table function."""
    table_function.register(spark)
    docs = _spread(_nested_docs(spark, sf_dir, "括号"))
    return spark.sql("SELECT law_id, m.start, m.end, m.type, m.text, marker_ordinal(m.kind, m.number)[0] AS ord FROM {docs}, LATERAL ordinal_markers(text) m", docs=docs)


#: Fragments of the articles, with the priority of their order: each has its type, level and length.
@query(
    f"""WITH{_LINES}, m AS (SELECT law_id, rn, '第' || cn || '条 货物' || l_partkey || '。' AS line, count(*) OVER (PARTITION BY law_id) AS n FROM x),
f AS (SELECT law_id, '条' AS split_type, 0 AS index_level, length(line) AS size FROM m WHERE n >= 3 UNION ALL SELECT law_id, NULL, NULL, sum(length(line) + 1) - 1 FROM m WHERE n < 3 GROUP BY law_id),
j AS (SELECT f.*, o_orderpriority AS lang FROM f JOIN orders ON o_orderkey = law_id)
SELECT lang, split_type, index_level::INT AS index_level, GROUPING(lang, split_type, index_level)::BIGINT AS grouping, count(*) AS fragments, count(DISTINCT law_id) AS documents, sum(size)::BIGINT AS characters FROM j
GROUP BY GROUPING SETS ((lang, split_type, index_level), (lang, split_type), (split_type, index_level), (lang), ())"""
)
def fragment_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of fragments by class, type and level, and their totals, in one pass over the split."""
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("law_id"), F.col("o_orderpriority").alias("lang"))
    return api.fragment_rollup(api.split_documents(_spread(_articles(spark, sf_dir).join(orders, "law_id"))))


@query(
    _WHOLE
    + """, f AS (SELECT m.law_id, md5(string_agg(rn || line, '|' ORDER BY rn)) AS content, count(*) AS k FROM m JOIN t USING (law_id) WHERE t.n >= 3 GROUP BY m.law_id UNION ALL SELECT law_id, md5('1' || text), 1 FROM t WHERE n < 3)
SELECT law_id::VARCHAR AS law_id, length(text)::VARCHAR AS raw_char_count, CASE WHEN n >= 3 THEN '条' ELSE '纯文本' END AS split_types, CASE WHEN n < 3 THEN n::VARCHAR END AS para_count, k AS fragments, content FROM t JOIN f USING (law_id)"""
)
def workbook_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all articles written as spreadsheets and read back: both sheets, joined."""
    path = f"{shared_folder(spark)}/workbooks-{uuid.uuid4().hex}"
    workbook.write_report_workbooks(api.split_documents(_spread(_articles(spark, sf_dir))), path)
    reports = workbook.sheet_of(spark, path, workbook.REPORT, ["law_id", "文本长度", "最终拆分类型", "段落数"])
    parts = workbook.sheet_of(spark, path, workbook.FRAGMENTS, ["组", "序号", "内容"]).groupBy(F.col("组").alias("law_id"))
    line = F.sort_array(F.collect_list(F.struct(F.col("序号").cast("int").alias("n"), "内容")))
    parts = parts.agg(F.count("*").alias("fragments"), F.md5(F.array_join(F.transform(line, lambda x: F.concat(x["n"].cast("string"), x["内容"])), "|")).alias("content"))
    return reports.select("law_id", F.col("文本长度").alias("raw_char_count"), F.col("最终拆分类型").alias("split_types"), F.col("段落数").alias("para_count")).join(parts, "law_id")


@query(
    f"""WITH{_LINES}, m AS (SELECT law_id, rn, count(*) OVER (PARTITION BY law_id) AS n, '第' || cn || '条 自2025年' || (1 + rn % 9) || '月1日起，重' || l_partkey || '吨，见附件' || rn || '、表' || rn || '，按第2款。' AS line FROM x)
SELECT law_id, rn::INT AS seq, line AS content FROM m WHERE n >= 3 UNION ALL SELECT law_id, 1, string_agg(line, chr(10) ORDER BY rn) FROM m WHERE n < 3 GROUP BY law_id"""
)
def restored_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles full of dates, weights and references, which are masked while the text is cut and stand in its fragments again."""
    line = F.concat(F.lit("第"), "cn", F.lit("条 自2025年"), 1 + F.col("rn") % 9, F.lit("月1日起，重"), "l_partkey", F.lit("吨，见附件"), "rn", F.lit("、表"), "rn", F.lit("，按第2款。"))
    return api.fragments_table(api.split_documents(_spread(_texts(_lines(spark, sf_dir), line)))).select("law_id", "seq", "content")


#: A stray article at the end, which scoring rolls back.
_STRAY = "第三十条 远"


@query(
    _PARTS
    + f""", size AS (SELECT law_id, count(*) AS n FROM x GROUP BY law_id),
b AS (SELECT p.*, size.n, CASE WHEN size.n >= 5 THEN type IN ('章', '节', '条') ELSE type = '括号' END AS cuts FROM placed p JOIN size USING (law_id)),
g AS (SELECT *, count(*) FILTER (cuts) OVER (PARTITION BY law_id ORDER BY rn, k) AS piece FROM b),
f AS (SELECT law_id, n, piece, string_agg(marker || rest, chr(10) ORDER BY rn, k) AS content, min_by(type, start) AS type FROM g GROUP BY ALL)
SELECT law_id, row_number() OVER w::INT AS seq, content || CASE WHEN lead(piece) OVER w IS NULL THEN chr(10) || '{_STRAY}' ELSE '' END AS content, CASE WHEN piece > 0 THEN type END AS split_type,
 CASE WHEN piece = 0 THEN NULL WHEN n < 5 THEN 0 WHEN type = '节' THEN 0 WHEN type = '章' THEN 1 ELSE 2 END::INT AS index_level, CASE WHEN n >= 5 AND lead(piece) OVER w IS NULL THEN 'rollback:条@30' ELSE '' END AS extra
FROM f WINDOW w AS (PARTITION BY law_id ORDER BY piece)"""
)
def nested_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters, sections and articles with brackets, and a stray article at the end: fragments of several types, levels and a rollback."""
    docs = _nested_docs(spark, sf_dir, "括号").withColumn("text", F.concat("text", F.lit("\n" + _STRAY)))
    return api.fragments_table(api.split_documents(_spread(docs))).select("law_id", "seq", "content", "split_type", "index_level", "extra")


@query(
    f"""WITH{_LINES}, d AS (SELECT law_id, count(*) AS n FROM x GROUP BY law_id)
SELECT law_id, 'forced' AS kind, CASE WHEN n >= 3 THEN '中文是,条' ELSE '纯文本' END AS all_tags, CASE WHEN n >= 3 THEN '条' ELSE '纯文本' END AS spine_types, CASE WHEN n >= 3 THEN n ELSE 0 END::INT AS max_n, CASE WHEN n >= 3 THEN 1 ELSE 0 END::INT AS max_gc FROM d
UNION ALL SELECT law_id, 'kinds', CASE WHEN n >= 3 THEN '文书类型' ELSE '纯文本' END, CASE WHEN n >= 3 THEN '文书类型' ELSE '纯文本' END, 0, CASE WHEN n >= 3 THEN n ELSE 0 END::INT FROM d
UNION ALL SELECT law_id, 'fallback', CASE WHEN n >= 5 THEN '括号,条' WHEN n >= 3 THEN '括号' ELSE '括号,数字点' END, CASE WHEN n >= 5 THEN '条' WHEN n >= 3 THEN '括号' ELSE '括号,数字点' END, CASE WHEN n >= 5 THEN n ELSE 3 END::INT, n::INT FROM d"""
)
def tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules of the report: enumerations that count without groups, kinds of documents that count by their number, and brackets that stay because dotted numbers were suppressed."""
    lines = _lines(spark, sf_dir)
    article = F.concat(F.lit("第"), "cn", F.lit("条 货物。"))
    # 三是, 二是, 一是 backwards: a run among the values, but no group
    back = lines.withColumn("back", F.count("*").over(Window.partitionBy("law_id")) - F.col("rn") + 1)
    backwards = _texts(back.withColumn("rn", F.col("rn") + 100), F.concat(int_to_cn(F.col("back")), F.lit("是甲乙"))).withColumnRenamed("text", "more")
    forced = _texts(lines, article).join(backwards.select("law_id", "more"), "law_id").select("law_id", F.lit("forced").alias("kind"), F.concat_ws("\n", "text", "more").alias("text"))
    kinds = _texts(lines, F.lit("《通知》 甲")).select("law_id", F.lit("kinds").alias("kind"), "text")
    inner = "".join(f"\n（{c}）甲" for c in "一二三") + "".join(f"\n1.{k} 乙" for k in (1, 2, 3))
    fallback = _texts(lines, F.concat(article, F.lit(inner))).select("law_id", F.lit("fallback").alias("kind"), "text")
    out = api.analyse_documents(_spread(forced.union(kinds).union(fallback)))
    return out.select("law_id", "kind", F.array_join("report.all_tags", ",").alias("all_tags"), F.array_join("report.spine_types", ",").alias("spine_types"), "report.max_n", "report.max_gc")
