"""Documents that are delivered again, late or changed, over restarts of the stream."""

import datetime

from clauseframe.streaming import intake, stream

FIRST = "\n".join(f"第{c}条 内容{c}。" for c in "一二三四")
SCHEMA = "law_id string, text string, arrived timestamp"


def test_each_version_is_split_once(spark, tmp_path):
    day = lambda n, hour=0: datetime.datetime(2024, 1, n, hour)

    def deliver(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        docs = stream.read_documents(spark, str(tmp_path / "in"), SCHEMA)
        intake.write_versions(docs, str(tmp_path / "out"), str(tmp_path / "state"), delay="2 days").awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    out = deliver(("a", FIRST, day(1)), ("a", FIRST, day(1, 5)), ("b", "甲", day(1)), ("n", None, day(1)))
    assert sorted((r["law_id"], len(r["fragments"])) for r in out.collect()) == [("a", 4), ("b", 1), ("n", 0)]
    # a restart: what comes again is known, a changed text is a new version
    out = deliver(("a", FIRST, day(2)), ("b", "乙", day(2)), ("c", FIRST, day(2)))
    assert sorted(r["law_id"] for r in out.collect()) == ["a", "b", "b", "c", "n"]
    assert {r["law_id"]: r["fragments"][0]["content"] if r["fragments"] else None for r in intake.current(out).collect()} == {"a": "第一条 内容一。", "b": "乙", "c": "第一条 内容一。", "n": None}
    # the state is bounded: what is older than the delay is dropped
    out = deliver(("d", "丁", day(9)))
    out = deliver(("e", "too late", day(3)), ("f", "in time", day(8)))
    assert sorted(r["law_id"] for r in out.collect()) == ["a", "b", "b", "c", "d", "f", "n"]
