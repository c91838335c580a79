"""WARC archives: written, read back through the chain of records, and held against plain loops and SQL."""

import base64
import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from clauseframe.llm import warc


def forged(body: str) -> str:
    """A whole record, as it would stand in an archive."""
    n = len(body.encode())
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nPage-ID: 999\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n"


PAYLOADS = ["<p>one</p>", "WARC/1.1\r\n", forged("x"), "a" + forged("y") + forged("WARC/1.1\r\n") + "b", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\n", "WARC/1.1\r\n" * 5, "日本 é\x00\r\r\n", "\r\n\r\n", "z" * 70_000]
ROWS = [(i + 1, f"http://h/{i} a\r\nX: y", p) for i, p in enumerate(PAYLOADS)]
ROWS += [(50, "http://h/c", "<p>one</p>"), (0, None, "<p>one</p>"), (None, "u", "<p>one</p>"), (None, None, None), (60, "u", None), (61, "u", ""), (3, "u", PAYLOADS[2])]
ROWS += [(70, "u", "same"), (70, "u", "same"), (70, "v", "same"), (None, "u", "nobody"), (None, "u", "nobody")] + [(100 + i, "u", forged("copied")) for i in range(30)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "t", 1) for r in ROWS], "page_id long, url string, html string, type string, at int")


def plain(rows):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, members in groups.items():
        members.sort(key=lambda p: (p is None, p or 0))
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out += [(p, len(payload), digest, "revisit" if k else "response", members[0] if k else None) for k, p in enumerate(members)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("part_bytes", ["300", "128m"])
def test_round_trip_with_forged_records(spark, pages, tmp_path, part_bytes):
    """Files are cut at any place; payloads hold magic lines and whole records, which are not records of the archive."""
    path = f"file://{tmp_path}/archive"
    warc.write_archive(pages.repartition(3), path, spark)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", part_bytes)
    try:
        if part_bytes == "300":  # many tiny parts: without the long payload
            warc.write_archive(pages.where(F.length("html") < 1000).limit(9).coalesce(1), f"{path}2", spark)
            want, path = plain([r for r in ROWS if len(r[2] or "x" * 2000) < 1000][:9]), f"{path}2"
        else:
            want = plain(ROWS)
        records = warc.read_archive(spark, path).cache()
        assert rows_of(warc.pages_of(records)) == want
        assert {r["page_id"] for r in records.collect()} == {r[0] for r in want}  # no forged page
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


def test_archive_is_a_chain_of_whole_records(spark, pages, tmp_path):
    """Read as any reader of such files would: header, length, block, two line breaks."""
    warc.write_archive(pages.repartition(2), f"file://{tmp_path}/a", spark)
    seen, ids = [], set()
    for file in (tmp_path / "a").glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            head, _, rest = data[at:].partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            http, _, payload = rest[:n].partition(b"\r\n\r\n")
            seen.append((fields[b"WARC-Type"], int(fields.get(b"Page-ID", -1))))
            ids.add(fields[b"WARC-Record-ID"])
            if fields[b"WARC-Type"] == b"response":
                assert fields[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest())
                assert http.endswith(b"Content-Length: %d" % len(payload))
            at += len(head) + 4 + n + 4
    assert sorted(p for _, p in seen) == sorted(-1 if r[0] is None else r[0] for r in ROWS)
    assert len(ids) == len(ROWS)


def test_damaged_archives_raise(spark, pages, tmp_path):
    warc.write_archive(pages.limit(4).coalesce(1), f"file://{tmp_path}/a", spark)
    (file,) = (tmp_path / "a").glob("part-*")
    data = file.read_bytes()
    for name, bad in (("short", data[:-30]), ("front", data[5:]), ("length", data.replace(b"Content-Length: ", b"Content-Length: 1", 1))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(bad)
        with pytest.raises(ValueError, match="chain"):
            warc.read_archive(spark, f"file://{tmp_path}/{name}").collect()
    (tmp_path / "digest").mkdir()
    (tmp_path / "digest" / "x.warc").write_bytes(data.replace(b"<p>one</p>", b"<p>oNe</p>"))
    with pytest.raises(Exception, match="wrong payload digest"):
        warc.pages_of(warc.read_archive(spark, f"file://{tmp_path}/digest")).collect()


def test_reachable_doubles(spark):
    """A long chain beside one that nobody enters."""
    links = [("f", i * 3, i * 3 + 3) for i in range(100)] + [("f", 1, 7), ("f", 7, 9), ("g", 5, 9)]
    known = warc.reachable(spark.createDataFrame(links, "file string, at long, to long"), spark)
    assert sorted(map(tuple, known.collect())) == [("f", i * 3) for i in range(101)]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    got = warc.op12_warc(spark, "/root/testdata/sf0.001")
    assert rows_of(got) == sorted(con.sql(warc.SQL).fetchall(), key=str)


def test_empty_table(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/none", spark)
    assert rows_of(warc.pages_of(warc.read_archive(spark, f"file://{tmp_path}/none"))) == []
