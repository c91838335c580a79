"""WARC archives as text files of Spark, read back by verified chains of records.

Writing: a payload is a response once, for its first page, and revisited by its other pages. Payloads that no other page
shares go from the scan into the archive. A bitmap of hashes, of bounded size, says which payloads may be shared; only those
meet by a shuffle, and all copies but one stay where they are.

Reading: tasks cut the files at the magic line, wherever it stands, and emit for each candidate its place and the place where it ends by
its own length. From the beginning of each file these links are doubled (pointer jumping) until all places that can
be reached are known; a magic line within a payload is not among them. Payloads that were cut at one are put together again.
A file whose chain doesn't end at its last byte raises, and so does a payload that doesn't have its record's digest.

Edge cases: a null html is an empty payload, shared like any other; a null url gives no target; of rows that repeat page_id and
payload one is the response; a null page_id comes last among equal payloads and stays null; an empty table gives an archive
without records. Control characters and blanks of urls are escaped. Other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseframe.functions.sql import let
from clauseframe.llm import textcore as tc
from clauseframe.llm.keyed import joined

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The pages say nothing about when they were fetched.
DATE = "2000-01-01T00:00:00Z"
#: Hexadecimal digits of a hash that the bitmap goes by: at most 16**5 numbers are broadcast.
DIGITS = 5
RECORDS_A_FILE = 200_000
#: Pieces of cut payloads up to which their places are broadcast.
BROADCAST_PIECES = 1 << 18
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIELDS = "type string, record_id string, page_id long, target string, refers_to_id string, declared_digest string, payload_bytes long, payload_digest string"


def _base32(sha1: str) -> str:
    """SQL for the base32 form of a hexadecimal hash: of each five digits, four letters."""
    five = "int(conv(substr(s, 1 + 5 * (i div 4), 5), 16, 10))"
    return let(sha1, "s", f"array_join(transform(sequence(0, 31), i -> substr('{_LETTERS}', 1 + (shiftright({five}, 15 - 5 * (i % 4)) & 31), 1)), '')")


def _uuid(*parts: str) -> str:
    """SQL for a record's name that follows from its parts."""
    given = f"md5(concat_ws('|', {', '.join(parts)}))"
    return let(given, "u", "'<urn:uuid:' || concat_ws('-', substr(u, 1, 8), substr(u, 9, 4), substr(u, 13, 4), substr(u, 17, 4), substr(u, 21)) || '>'")


def _record(kind: str, name: str, more: str, payload: str, length: str) -> Column:
    """A record from the columns page_id, url and sha; the writer adds its last line break."""
    http = f"'HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ' || {length} || '\\r\\n\\r\\n'"
    target = r"replace(replace(regexp_replace(url, '[\\x00-\\x1F\\x7F]', '%20'), ' ', '%20'), '\u0085', '%20')"
    head = f"""concat('{MAGIC[:-2]}\\r\\nWARC-Type: {kind}\\r\\nWARC-Record-ID: ', {name}, '\\r\\nWARC-Date: {DATE}\\r\\n',
        coalesce('WARC-Target-URI: ' || {target} || '\\r\\n', ''), coalesce('Page-ID: ' || page_id || '\\r\\n', ''), {more},
        'WARC-Payload-Digest: sha1:', {_base32("sha")}, '\\r\\nContent-Type: application/http; msgtype=response\\r\\nContent-Length: ')"""
    return F.expr(let(http, "h", f"concat({head}, octet_length(h) + octet_length({payload}), '\\r\\n\\r\\n', h, {payload}, '\\r\\n')")).alias("value")


def archive_records(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """pages (page_id, url, html) -> (value): the text of each record, in any order."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha1("html")).withColumn("bit", F.substring("sha", 1, DIGITS))
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("bare"), "url", "row")).alias("first")
    # without the payloads; every row gets a number, as rows may repeat
    rows = tc.written(pages.select("page_id", "url", "sha", "bit", F.octet_length("html").alias("length"), F.monotonically_increasing_id().alias("row")), spark)
    shared = tc.written(rows.groupBy("sha", "bit").agg(F.count("*").alias("n"), first).where("n > 1"), spark)
    bitmap = F.broadcast(shared.select("bit").distinct())
    may, alone = pages.join(bitmap, "bit", "left_semi"), pages.join(bitmap, "bit", "left_anti")
    met = may.withColumn("row", F.lit(0)).groupBy("sha").agg(first, F.first("html").alias("html")).select("first.page_id", "first.url", "sha", "html")
    response = _record("response", _uuid("'response'", "sha"), "''", "html", "octet_length(html)")
    copies = joined(rows, shared.select("sha", F.col("first.row").alias("first"), "n"), ["sha"], "n", rows.count()).where("row <> first")
    refers = f"'WARC-Refers-To: ' || {_uuid(repr('response'), 'sha')} || '\\r\\nWARC-Profile: {PROFILE}\\r\\n'"
    revisit = _record("revisit", _uuid("'revisit'", "sha", "row"), refers, "''", "length")
    return alone.select(response).union(met.select(response)).union(copies.select(revisit))


def write_archive(pages: DataFrame, path: str, spark: SparkSession) -> None:
    """One file of records for each task that writes; a task that is lost is written again whole."""
    archive_records(pages, spark).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def _parsed(piece: bytes) -> tuple[int | None, tuple]:
    """Of the bytes after a magic line: the length that the record there claims, and its fields if the piece has just that length."""
    none = (None,) * 8
    head = piece.find(b"\r\n\r\n")
    if head < 0:
        return None, none
    fields = {}
    for line in piece[:head].split(b"\r\n"):
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or b"warc-type" not in fields:
        return None, none
    claimed = head + 4 + int(length) + 4
    if claimed != len(piece) or not piece.endswith(b"\r\n\r\n"):
        return claimed, none
    begins = head + 4
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        begins = piece.find(b"\r\n\r\n", begins) + 4
    payload = piece[begins:-4]
    text = lambda k: fields[k].decode("utf-8", "replace") if k in fields else None
    page = fields.get(b"page-id")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return claimed, (text(b"warc-type"), text(b"warc-record-id"), int(page) if page else None, text(b"warc-target-uri"), text(b"warc-refers-to"), (text(b"warc-payload-digest") or "").removeprefix("sha1:"), len(payload), digest)


_PLACES = "file string, block long, size long, piece long, bytes long, claimed long"


def _candidates(batches):
    """The pieces of each part of a file, in order: where they begin in it, how long they are and what they claim to be."""
    at: dict[tuple, int] = {}
    for batch in batches:
        out = [[] for _ in range(14)]
        for file, block, size, value in zip(*(batch.column(k).to_pylist() for k in ("file", "block", "size", "value"))):
            begins = at.get((file, block), 0)
            at[file, block] = begins + len(value) + len(MAGIC)
            claimed, fields = _parsed(value)
            for column, x in zip(out, (file, block, size, begins, len(value), claimed, *fields)):
                column.append(x)
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string()]
        names = [f.split()[0] for f in f"{_PLACES}, {_FIELDS}".split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def _texts(batches):
    """The same pieces with their bytes."""
    at: dict[tuple, int] = {}
    for batch in batches:
        begins = []
        for file, block, value in zip(*(batch.column(k).to_pylist() for k in ("file", "block", "value"))):
            begins.append(at.get((file, block), 0))
            at[file, block] = begins[-1] + len(value) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(begins, pa.int64()), batch.column("value")], ["file", "block", "piece", "value"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


def reachable(links: DataFrame, spark: SparkSession) -> DataFrame:
    """links (file, at, to), to > at, one for each (file, at) -> (file, at) of all that can be reached from a file's 0, ends included.

    After k rounds the first 2**k of each file are known, and links are 2**k steps long.
    """
    jumps = tc.written(links, spark)
    known = jumps.where("at = 0").select("file", "at")
    while True:
        new = tc.written(known.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at")), spark)
        if new.isEmpty():
            return known
        known = tc.written(known.union(new), spark)
        twice = jumps.alias("a").join(jumps.alias("b"), F.expr("a.file = b.file AND a.to = b.at"))
        jumps = tc.written(twice.select("a.file", "a.at", "b.to"), spark)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, at, type, record_id, page_id, target, refers_to_id, declared_digest, payload_bytes, payload_digest) of all records."""
    pieces = tc.written(_lines(spark, path).mapInArrow(_candidates, f"{_PLACES}, {_FIELDS}"), spark)
    magic = len(MAGIC)
    blocks = pieces.groupBy("file", "block").agg(F.sum(F.col("bytes") + magic).alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = tc.written(blocks.select("file", "block", before.alias("begins")), spark)
    # a piece's record begins with the magic line before it; the first piece of a file has none
    placed = pieces.join(blocks, ["file", "block"]).withColumn("at", F.col("begins") + F.col("piece") - magic).withColumn("to", F.col("at") + magic + F.col("claimed"))
    placed = tc.written(placed, spark)
    known = reachable(placed.where("at >= 0 AND claimed IS NOT NULL").select("file", "at", "to"), spark)
    ends = placed.select("file", "size").distinct().where("size > 0").join(known, "file", "left").groupBy("file").agg(F.max(F.expr("at = size")).alias("whole"))
    broken = ends.where("NOT coalesce(whole, false)").select("file").limit(3).collect()
    if broken:
        raise ValueError(f"no chain of records ends where the file ends: {[r['file'] for r in broken]}")
    fields = [f.split()[0] for f in _FIELDS.split(", ")]
    records = placed.join(known, ["file", "at"])
    whole = records.where("type IS NOT NULL").select("file", "at", *fields)
    cut = tc.written(records.where("type IS NULL").select("file", "at", "to"), spark)
    if cut.isEmpty():
        return whole
    return whole.union(_mended(spark, path, placed, cut).select("file", "at", *fields))


def _mended(spark: SparkSession, path: str, placed: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines: all pieces up to the record's end, joined."""
    # the last record that begins at or before a piece, among those that were cut, is the one that it may belong to
    marks = placed.select("file", "block", "piece", "at").unionByName(cut.select("file", "at", "to"), allowMissingColumns=True)
    last = Window.partitionBy("file").orderBy("at", F.col("to").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("to").isNotNull(), F.struct(F.col("at").alias("owner"), F.col("to").alias("until"))), ignorenulls=True).over(last)
    parts = marks.select("file", "block", "piece", "at", "to", owner.alias("o")).where("to IS NULL AND o IS NOT NULL AND at < o.until")
    parts = tc.written(parts.select("file", "block", "piece", "at", "o.owner"), spark)
    wanted = F.broadcast(parts) if parts.count() <= BROADCAST_PIECES else parts
    texts = _lines(spark, path).mapInArrow(_texts, "file string, block long, piece long, value binary").join(wanted, ["file", "block", "piece"])
    found = texts.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts")).select("file", F.col("owner").alias("at"), "parts")

    def run(batches):
        for batch in batches:
            rows = [_parsed(MAGIC.encode().join(p["value"] for p in parts))[1] for parts in batch.column("parts").to_pylist()]
            kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string()]
            columns = list(zip(*rows)) or [()] * 8
            names = [f.split()[0] for f in _FIELDS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("at"), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], ["file", "at", *names])

    return found.mapInArrow(run, f"file string, at long, {_FIELDS}")


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, a revisit's payload being that of the response which it names."""
    sound = F.when(F.col("declared_digest") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("wrong payload digest in "), "record_id")))
    responses = records.where("type = 'response'")
    revisits = records.where("type = 'revisit'").select("page_id", F.col("refers_to_id").alias("record_id"))
    counts = revisits.groupBy("record_id").agg(F.count("*").alias("n"))
    named = responses.select("record_id", "payload_bytes", sound.alias("payload_digest"), F.col("page_id").alias("refers_to")).join(counts, "record_id")
    found = joined(revisits, named, ["record_id"], "n", revisits.count())
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = responses.select("page_id", "payload_bytes", sound.alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(found.withColumn("record_type", F.lit("revisit")).select(*out))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{tc.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(tc.read_table(spark, sf_dir, "pages"), path, spark)
    return pages_of(tc.written(read_archive(spark, path), spark))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, row_number() OVER (PARTITION BY html ORDER BY page_id) AS k, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id) AS f FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_reduce(list_prepend('', [substr('{_LETTERS}', CAST(1 + ((CAST('0x' || substr(sha, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1) FOR i IN range(32)]), lambda a, x: a || x) AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM s
"""
