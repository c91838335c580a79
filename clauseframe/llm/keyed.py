"""Joins of a large table to one row a key, and dense names of keys, that hold when one key has a third of the rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseframe.llm.textcore import fresh, written

#: A key with more than a HOT-th of the rows is hot; so there are fewer than HOT of them.
HOT = 1000


def joined(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows to a table with one row for each key; `count` says how many of `total` rows have the key, and is left out.

    The fewer than HOT hot keys are broadcast, so their rows stay where they are; the others meet by a shuffle.
    """
    is_hot = F.col(count) * HOT > total
    hot, cold = table.where(is_hot).drop(count), table.where(~is_hot).drop(count)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def numbered(table: DataFrame, name: str, spark: SparkSession) -> tuple[DataFrame, int]:
    """The table, written, with the numbers from 0 on in its order, and how many rows it has. The driver sees a count for each partition."""
    at = fresh(table.columns, "row_at")
    table = written(table.withColumn(at, F.monotonically_increasing_id()), spark)
    part = F.shiftright(at, 33)
    sizes = sorted((r["part"], r["n"]) for r in table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    if not sizes:
        return table.select("*", F.lit(0).cast("long").alias(name)).drop(at), 0
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "part int, part_begins long")
    dense = table.withColumn("part", part.cast("int")).join(F.broadcast(offsets), "part").withColumn(name, F.col("part_begins") + F.col(at).bitwiseAND((1 << 33) - 1))
    return dense.drop("part", "part_begins", at), before[-1]


def named(rows: DataFrame, keys: list[str], name: str, spark: SparkSession, **more) -> DataFrame:
    """Rows (a written table) with a dense number for each distinct key, and aggregates of all rows with it (`more`)."""
    size = fresh([*rows.columns, *more], "key_rows")
    counts = rows.groupBy(*keys).agg(F.count("*").alias(size), *[c.alias(k) for k, c in more.items()])
    table, _ = numbered(counts, name, spark)
    return joined(rows, table, keys, size, rows.count())
