"""Documents end to end, on small fixtures and on the given tables against DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from clauseframe.functions.sql import tried
from clauseframe.operators import markers
from clauseframe.plans import api, queries
from clauseframe.sources import tables
from clauseframe.streaming import stream

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ARTICLES = "\n".join(f"第{c}条 内容{c}。" for c in "一二三四五六七八九十")
MIXED = "第一条 甲\n一、子\n二、丑\n三、寅\n第二条 乙\n一、子\n二、丑\n三、寅\n第三条 丙\n第四条 丁\n第五条 戊\n第三十条 远"


@pytest.fixture(scope="module")
def split(spark):
    rows = [("articles", ARTICLES), ("mixed", MIXED), ("two", "第一条 甲。第二条 乙。"), ("plain", "甲\n乙\n丙"), ("empty", ""), ("null", None), ("html", "<p>第一条 遵守&lt;法&gt;。</p>\n<p>第二条 乙</p>\n<p>第三条 丙</p>")]
    return {r["law_id"]: r for r in api.split_documents(spark.createDataFrame(rows, "law_id string, text string")).collect()}


def test_articles(split):
    got = split["articles"]
    assert got["split_types"] == ["条"] and [f["ordinal"] for f in got["fragments"]] == [[i] for i in range(1, 11)]
    assert "\n".join(f["content"] for f in got["fragments"]) == ARTICLES
    assert {f["index_level"] for f in got["fragments"]} == {0} and got["meta"]["level_chain"] == "条(0)"


def test_two_types_and_a_stray(split):
    got = split["mixed"]
    assert set(got["split_types"]) == {"条", "中文顿号"}
    assert [f["seq"] for f in got["fragments"]] == list(range(1, len(got["fragments"]) + 1))
    assert got["fragments"][-1]["extra"] == "rollback:条@30" and "第三十条" in got["fragments"][-1]["content"]
    assert {f["split_type"]: f["index_level"] for f in got["fragments"]} == {"条": 0, "中文顿号": 1}


def test_plain_and_missing(split):
    assert [len(split[k]["fragments"]) for k in ("two", "plain", "empty", "null")] == [1, 1, 0, 0]
    assert split["empty"]["error"] == api.EMPTY and split["null"]["error"] == api.MISSING and split["two"]["error"] is None
    assert split["plain"]["report"]["is_plain"] and split["plain"]["report"]["para_count"] == 3


def test_a_failing_document_is_an_error_of_its_own(spark):
    docs = spark.createDataFrame([("good", ARTICLES), ("bad", "第一条 坏"), ("null", None)], "law_id string, text string")

    def extra(kind: str, left: str, right: str) -> bool:
        if "坏" in right:
            raise RuntimeError("bad")
        return False

    found = docs.select("law_id", F.size(markers.raw_markers(F.col("text"), extra=extra)).alias("n"), markers.raw_markers(F.col("text"), extra=extra).isNull().alias("none"))
    assert {(r[0], r[2]) for r in found.collect()} == {("good", False), ("bad", True), ("null", True)}
    assert tried(lambda x: 1 // x)(0) is None and tried(lambda x: 1 // x)(1) == 1


def test_an_error_says_what_failed(spark, monkeypatch):
    """One document fails in each of the steps that can; the others and their fragments stay."""
    from clauseframe.operators import levels, score

    rows = [("good", ARTICLES), ("level", ARTICLES.replace("内容一", "坏级")), ("null", None)]
    docs = spark.createDataFrame(rows, "law_id string, text string")

    def extra(kind: str, left: str, right: str) -> bool:
        if "坏级" in right:
            raise KeyError("no such rule")
        return False

    found = markers.found_spans
    monkeypatch.setattr(markers, "found_spans", lambda text, **more: found(text, **{**more, "extra": extra}))
    got = {r["law_id"]: (r["error"], len(r["fragments"])) for r in api.split_documents(docs).collect()}
    assert got == {"good": (None, 10), "level": (f"{api.FAILED}: KeyError: 'no such rule'", 0), "null": (api.MISSING, 0)}
    # the two other steps keep the reason as well
    bad = spark.createDataFrame([(1, [[1], [2]], ["条"]), (2, [[1], []], ["条", "章"])], "id long, ords array<array<long>>, types array<string>")
    scores = {r["id"]: r["s"] for r in bad.select("id", score.checked_scores("ords").alias("s")).collect()}
    assert scores[1]["error"] is None and scores[1]["rows"][0]["score"] == -2.0 and scores[2]["error"].startswith("IndexError") and scores[2]["rows"] is None
    assert all(r["s"]["error"] is None and r["s"]["rows"] for r in bad.select(levels.checked_levels("types").alias("s")).collect())


def test_guards_look_over_any_number_of_blanks(spark):
    cases = [("意" + " " * n + "见第五条", True) for n in (0, 60, 70, 500)] + [("甲见" + " " * n + "第五条", False) for n in (0, 70)] + [("见第五条", False), ("见" + "\n" * 100 + "第五条", False), ("甲按规定" + "　" * 90 + "第五条", False)]
    docs = spark.createDataFrame(cases, "text string, kept boolean")
    assert docs.where((F.size(markers.raw_markers(F.col("text"), ["条"])) > 0) != F.col("kept")).collect() == []


def test_split_by_ids_splits_each_text_once(spark):
    source = spark.createDataFrame([("a", ARTICLES), ("a", "甲"), ("a", ARTICLES), ("b", "甲"), ("z", "乙"), (None, "丙")], "law_id string, text string")
    out = api.split_by_ids(tables.ids_from_list(spark, ["a", "b", "b", "b", "c"]), source, parts=3)
    got = sorted((r["law_id"], len(r["fragments"]), r["error"]) for r in out.collect())
    assert [g[0] for g in got] == ["a", "b", "b", "b", "c"] and got[0][1] in (1, 10) and got[4][2] == api.MISSING
    assert out.rdd.getNumPartitions() == 3  # the texts are not broadcast into one task


def test_type_report_of_near_misses(spark):
    text = "\n".join([f"第{c}章 甲" for c in "一二三四五"] + [f"第{c}条 乙" for c in "一二三四"] + ["6.1.1 甲", "6.1.2 乙", "6.1.3 丙"] + [f"{n}、丁" for n in range(1, 11)])
    rows = {r["type"]: r for r in api.type_report(api.analyse_documents(spark.createDataFrame([(1, text)], "law_id long, text string"))).collect()}
    assert rows["章"]["group_labels"] == "1-5" and rows["数字点"]["group_labels"] == "6.1.1-3" and rows["数字点"]["ordinals"] == "6.1.1, 6.1.2, 6.1.3"
    assert rows["数字顿号"]["ordinals"] == "1, 2, 3, 4, 5, 6, 7, 8 (+2)" and rows["数字顿号"]["reason"] == "包容抑制(条)"
    assert rows["章"]["part"] == "spine" and rows["条"]["part"] in ("satellite", "near spine")


def test_fragment_cap_and_one_text(spark):
    docs = spark.createDataFrame([("a", ARTICLES), ("b", "甲")], "law_id string, text string")
    got = {r["law_id"]: (r["error"], len(r["fragments"]), r["meta"]["fragment_count"]) for r in api.split_documents(docs, max_fragments=9).collect()}
    assert got == {"a": (api.TOO_MANY, 0, 10), "b": (None, 1, 1)}
    one = api.split_text(spark, ARTICLES)
    assert [f["ordinal"] for f in one["fragments"]] == [[i] for i in range(1, 11)] and one["meta"]["fragment_count"] == 10 and one["meta"]["processing_ms"] >= 0
    assert api.split_text(spark, " ") == {"error": api.EMPTY} and api.split_text(spark, ARTICLES, 9) == {"error": api.TOO_MANY}


def test_html(split):
    assert split["html"]["fragments"][0]["content"] == "第一条 遵守<法>。" and len(split["html"]["fragments"]) == 3


def test_ids_resume_and_files(spark, tmp_path):
    source = spark.createDataFrame([("a", ARTICLES), ("a", ARTICLES), ("b", "甲")], "law_id string, text string")
    ids = tables.ids_from_list(spark, ["a", "b", "c"])
    out = api.split_by_ids(ids, source)
    assert {(r["law_id"], r["n"], r["error"]) for r in out.select("law_id", F.size("fragments").alias("n"), "error").collect()} == {("a", 10, None), ("b", 1, None), ("c", 0, api.MISSING)}
    assert {r[0] for r in api.resume(ids, source.select("law_id")).collect()} == {"c"}
    (tmp_path / "ids.csv").write_text("law_id\n a \n\nb\na\n")
    assert sorted(r[0] for r in tables.ids_from_csv(spark, str(tmp_path / "ids.csv")).collect()) == ["a", "a", "b"]
    assert tables.ids_from_csv(spark, str(tmp_path / "ids.csv"), "other").count() == 0
    (tmp_path / "one.txt").write_text(ARTICLES)
    assert tables.text_files(spark, str(tmp_path / "one.txt")).first()["text"] == ARTICLES
    tables.write_reports(out, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/fragments")).count() == 11
    tables.append_snapshot(out, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 3


def test_jdbc_needs_configuration(spark, monkeypatch):
    monkeypatch.delenv("LEGAL_DB_HOST", raising=False)
    config = tables.JdbcConfig.from_env()
    assert not config.configured()
    with pytest.raises(ValueError):
        tables.jdbc_documents(spark, config, "laws", "law_id", "text")


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([("a", ARTICLES), ("b", MIXED)], "law_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream.write_fragments(stream.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r["law_id"], r["seq"], r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["law_id"], r["seq"], r["content"]) for r in api.fragments_table(api.split_documents(docs)).collect()}
    assert got == want


def _rows(df):
    text = lambda v: "" if v is None or str(v) in ("nan", "<NA>", "None") else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    columns = sorted(df.columns)
    return columns, sorted(tuple(map(text, row)) for row in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    assert _rows(queries.QUERIES[name](spark, SF).toPandas()) == _rows(con.execute(queries.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_split_by_ids_equals_its_sql_on_odd_documents(spark, tmp_path):
    """Repeated ids, repeated documents, texts that are null, blank or tags alone, and no text for an id."""
    docs = [(1, ARTICLES), (1, "甲\n\n 乙"), (1, "甲\n\n 乙"), (2, ""), (3, " \n\t"), (4, "<p></p>"), (5, None), (6, "第一条 甲。"), (None, "丙")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 4, 5, 6, 7, None)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("documents", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = _rows(queries.QUERIES["split_by_ids"](spark, str(tmp_path)).toPandas())
    assert got == _rows(con.execute(queries.ORACLE_SQL["split_by_ids"]).df()) and len(got[1]) == 13
