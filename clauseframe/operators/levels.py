"""Hierarchy of fragment types from their order: which type stands inside which, and how deep."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.functions.sql import checked, remembered, rows_with_errors


def containment(sequence: DataFrame) -> DataFrame:
    """(law_id, pos, type) -> (law_id, outer, inner, n): how often inner stands between two outer ones, or after a single outer one.

    As the gaps between neighbours of a type tile the span from its first to its last place, these are range counts.
    """
    spans = sequence.groupBy("law_id", F.col("type").alias("outer")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("c"))
    inner = sequence.select("law_id", "pos", F.col("type").alias("inner"))
    inside = inner.join(spans, "law_id").where("inner <> outer AND pos > lo AND (c = 1 OR pos < hi)")
    return inside.groupBy("law_id", "outer", "inner").agg(F.count("*").alias("n"))


def edges(contained: DataFrame) -> DataFrame:
    """Parent and child types: the one that holds the other more often than it is held."""
    back = contained.select("law_id", F.col("outer").alias("inner"), F.col("inner").alias("outer"), F.col("n").alias("m"))
    return contained.join(back, ["law_id", "outer", "inner"], "left").where("n > coalesce(m, 0)").select("law_id", "outer", "inner")


def infer_levels(types: Sequence[str]) -> list[tuple[str, int]]:
    """Types with their levels from 0, by level and first place."""
    names = list(dict.fromkeys(types))
    places = {t: [i for i, x in enumerate(types) if x == t] for t in names}

    def held(a: str, b: str) -> int:
        lo, hi = places[a][0], places[a][-1] if len(places[a]) > 1 else len(types)
        return sum(lo < i < hi for i in places[b])

    parents = {b: {a for a in names if a != b and held(a, b) > held(b, a)} for b in names}
    waiting = {t: len(parents[t]) for t in names}
    queue = [t for t in names if not waiting[t]]
    if not queue:  # all in cycles: the widest spread first
        spread = {t: (places[t][-1] - places[t][0]) / (len(places[t]) - 1) if len(places[t]) > 1 else float(len(types)) for t in names}
        queue = sorted(names, key=lambda t: -spread[t])
    order = []
    while queue:
        node = queue.pop(0)
        order.append(node)
        for child in names:
            if node in parents[child]:
                waiting[child] -= 1
                if not waiting[child]:
                    queue.append(child)
    level: dict[str, int] = {}
    for t in order + [t for t in names if t not in order]:
        level[t] = 1 + max((level[p] for p in parents[t] if p in level), default=-1)
    dense = {old: new for new, old in enumerate(sorted(set(level.values())))}
    return sorted(((t, dense[level[t]]) for t in names), key=lambda x: (x[1], names.index(x[0])))


def _levels(column):
    inferred = remembered(infer_levels)
    return rows_with_errors(((None, None) if types is None else inferred(tuple(x for x in types if x is not None)) for types in column.to_pylist()), [("type", pa.string()), ("level", pa.int32())])


_levels.__annotations__ = {"column": pa.Array, "return": pa.Array}
#: array<string> of types in order -> the levels as rows, or the error
checked_levels = F.arrow_udf(_levels, checked(T.StructType([T.StructField("type", T.StringType()), T.StructField("level", T.IntegerType())]))).asNondeterministic()  # so that the optimizer leaves it outside lambdas


def levels_udf(types) -> Column:
    """array<string> of types in order -> array<struct<type, level>>; null where it fails."""
    return checked_levels(types)["rows"]


def level_chain(levels: Column) -> Column:
    """条(0) > 括号(1), or - if there is no level."""
    parts = F.transform(levels, lambda x: F.concat(x["type"], F.lit("("), x["level"].cast("string"), F.lit(")")))
    return F.when(F.size(levels) > 0, F.array_join(parts, " > ")).otherwise("-")


def level_bars(levels: Column) -> Column:
    """章→条→中文顿号|括号: types of one level sorted."""
    depth = F.coalesce(F.array_max(F.transform(levels, lambda x: x["level"])), F.lit(-1))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(depth, F.lit(0))), lambda k: F.array_join(F.sort_array(F.transform(F.filter(levels, lambda x: x["level"] == k), lambda x: x["type"])), "|"))
    return F.when(depth >= 0, F.array_join(parts, "→")).otherwise("-")
