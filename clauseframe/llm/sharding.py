"""Sharding by extendible hashing, with DataFrame functions only.

A document's key is hashed to 60 bits. The directory is indexed by a prefix of the hash: a bucket is a prefix, and only a bucket
over the byte limit is split on one more bit, until every bucket fits. The bytes of a few more bits than needed on
average are aggregated at once (`STEP` bits a round); rounds go on only for buckets that are still too large.

Which prefixes are over the limit is found from pre-aggregated cells. Short prefixes, of which there are at most 2 ** SHORT for all
lengths together, are broadcast; longer ones are joined, where no prefix holds more than a small share of all hashes.

A bucket whose rows all have one hash can't be split by bits. Its rows are dealt into overflow parts: a row over half of the limit is a
part of its own (odd numbers), the others are put in the order of their sizes and cut by running sums (even numbers). Rows of a size are
counted by input partition first, so a hot key is never gathered in one task.

Result: doc_id, n_bytes, shard_id (a one bit and the prefix, as a number: unique over all depths), depth, overflow_part (0 in plain buckets).

Edge cases: a null text has 0 bytes; a null doc_id is a key of its own; rows with one doc_id go to one bucket; a
row over the limit is a part of its own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseframe.llm import textcore as tc

SHARD_BYTES = 1 << 20
HASH_BITS = 60
STEP = 8
SHORT = 16
BROADCAST_CELLS = 500_000


def _prefix(depth: int):
    return F.expr(f"shiftright(h, {HASH_BITS} - {depth})")


def shard(spark: SparkSession, docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """docs (doc_id, text) -> a row for each row of docs, with its shard."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
    )
    rows = tc.written(rows.withColumn("rid", F.monotonically_increasing_id()), spark)
    total, n = rows.agg(F.sum("n_bytes"), F.count("*")).first()
    low = 0
    high = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, (total or 0) / limit)))) + STEP)
    cells = rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.min("h").alias("first"), F.max("h").alias("last"))
    open_cells, found = tc.written(cells, spark), []
    while True:
        # a cell's depth: as many prefixes of it as are over the limit and hold more than one hash
        levels = open_cells.select("cell", "bytes", "first", "last", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, cast({high} - depth as int))"))
        over = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("b"), F.min("first").alias("first"), F.max("last").alias("last")).where((F.col("b") > limit) & (F.col("first") < F.col("last"))).select("depth", "prefix")
        over = tc.written(over, spark)
        short, long = levels.where(F.col("depth") < SHORT), levels.where(F.col("depth") >= SHORT)
        hit = short.join(F.broadcast(over.where(F.col("depth") < SHORT)), ["depth", "prefix"], "left_semi").union(long.join(over.where(F.col("depth") >= SHORT), ["depth", "prefix"], "left_semi"))
        depth = hit.groupBy("cell").agg(F.max("depth").alias("last_over"))
        placed = open_cells.join(depth, "cell", "left").withColumn("depth", F.coalesce(F.col("last_over") + 1, F.lit(low))).drop("last_over")
        placed = tc.written(placed.withColumn("high", F.lit(high)), spark)
        found.append(placed.where(F.col("depth") <= high))
        rest = placed.where(F.col("depth") > high)
        if high >= HASH_BITS or rest.isEmpty():
            break
        split = rows.join(rest.select("cell"), _prefix(high) == F.col("cell"), "left_semi")
        low, high = high + 1, min(HASH_BITS, high + STEP)
        open_cells = tc.written(split.groupBy(_prefix(high).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.min("h").alias("first"), F.max("h").alias("last")), spark)
    out = None
    for directory in found:
        bits = directory.select("high").first()
        if bits is None:
            continue
        small = directory.select("cell", "depth", (F.col("bytes") > limit).alias("over"))
        small = F.broadcast(small) if small.count() <= BROADCAST_CELLS else small
        part = rows.withColumn("cell", _prefix(bits[0])).join(small, "cell")
        part = part.withColumn("shard_id", F.expr(f"shiftleft(1L, depth) | shiftright(cell, {bits[0]} - depth)"))
        out = part if out is None else out.union(part)
    if out is None:
        return rows.select("doc_id", "n_bytes", F.lit(1).cast("long").alias("shard_id"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("overflow_part"))
    plain = out.where("NOT over").withColumn("overflow_part", F.lit(0).cast("long"))
    dealt = _overflow(out.where("over"), limit)
    columns = ["doc_id", "n_bytes", "shard_id", F.col("depth").cast("int").alias("depth"), "overflow_part"]
    return plain.select(*columns).union(dealt.select(*columns))


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets of one hash with their overflow parts."""
    rows = rows.withColumn("big", F.col("n_bytes") * 2 > limit).withColumn("home", F.shiftright("rid", 33))
    counts = rows.groupBy("shard_id", "big", "n_bytes", "home").agg(F.count("*").alias("c"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("shard_id", "big", "n_bytes").agg(F.sum("c").alias("c"))
    by_size = before(Window.partitionBy("shard_id", "big").orderBy("n_bytes"))
    room = F.lit(limit) - F.max("n_bytes").over(Window.partitionBy("shard_id", "big"))
    sizes = sizes.select("shard_id", "n_bytes", room.alias("room"), F.coalesce(F.sum("c").over(by_size), F.lit(0)).alias("rows_before"), F.coalesce(F.sum(F.col("c") * F.col("n_bytes")).over(by_size), F.lit(0)).alias("bytes_before"))
    by_home = before(Window.partitionBy("shard_id", "n_bytes").orderBy("home"))
    homes = counts.select("shard_id", "n_bytes", "home", F.coalesce(F.sum("c").over(by_home), F.lit(0)).alias("elsewhere"))
    own = F.row_number().over(Window.partitionBy("shard_id", "n_bytes", "home").orderBy("rid")) - 1
    placed = rows.withColumn("own", own).join(homes, ["shard_id", "n_bytes", "home"]).join(sizes, ["shard_id", "n_bytes"]).withColumn("same", F.col("elsewhere") + F.col("own"))
    part = F.when(F.col("big"), 2 * (F.col("rows_before") + F.col("same")) + 1).otherwise(2 * F.floor((F.col("bytes_before") + F.col("same") * F.col("n_bytes")) / F.col("room")) + 2)
    return placed.withColumn("overflow_part", part.cast("long"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, tc.read_table(spark, sf_dir, "documents"))


SQL = f"""
WITH r AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
l AS (SELECT r.*, d, h >> ({HASH_BITS} - d)::INT AS p FROM r, (SELECT unnest(range(0, {HASH_BITS + 1})) AS d)),
s AS (SELECT d, p, sum(n_bytes) AS b, count(DISTINCT h) AS k FROM l GROUP BY d, p),
t AS (SELECT l.rid, l.doc_id, l.n_bytes, l.h, count(*) FILTER (b > {SHARD_BYTES} AND k > 1) AS depth FROM l JOIN s USING (d, p) GROUP BY ALL),
u AS (SELECT *, ((1::BIGINT << depth::INT) | (h >> ({HASH_BITS} - depth)::INT))::BIGINT AS shard_id, n_bytes * 2 > {SHARD_BYTES} AS big FROM t),
v AS (SELECT *, sum(n_bytes) OVER (PARTITION BY shard_id) > {SHARD_BYTES} AS over_limit, {SHARD_BYTES} - max(n_bytes) OVER (PARTITION BY shard_id, big) AS room,
  row_number() OVER (PARTITION BY shard_id, big ORDER BY n_bytes, rid) - 1 AS rows_before,
  coalesce(sum(n_bytes) OVER (PARTITION BY shard_id, big ORDER BY n_bytes, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before FROM u)
SELECT doc_id, n_bytes, shard_id, depth::INT AS depth, CASE WHEN NOT over_limit THEN 0 WHEN big THEN 2 * rows_before + 1 ELSE 2 * (bytes_before // room) + 2 END::BIGINT AS overflow_part FROM v
"""
