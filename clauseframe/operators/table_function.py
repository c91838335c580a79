"""Markers for SQL: a table function that is joined laterally to texts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from clauseframe.functions import catalog as C
from clauseframe.functions.ordinals import ordinal_sql
from clauseframe.operators.markers import _finder

_FIELDS = [("start", T.IntegerType()), ("end", T.IntegerType()), ("type", T.StringType()), ("text", T.StringType()), ("kind", T.StringType()), ("number", T.StringType())]


@udtf(returnType=T.StructType([T.StructField(n, t) for n, t in _FIELDS]))
class OrdinalMarkers:
    """ordinal_markers(text): its guarded markers by place; none for a null text, and none for one that can't be processed."""

    def __init__(self):
        self.find = _finder(None, True, None)

    def eval(self, text: str):
        found, _ = self.find(text) if text else (None, None)
        for start, _, _, seq, end, whole, number in found or ():
            yield start, end, C.TYPES[seq], whole, C.MARKERS[seq][1], number


def register(spark: SparkSession) -> None:
    """Make ordinal_markers(text) and marker_ordinal(kind, number) known to SQL of this session."""
    spark.udtf.register("ordinal_markers", OrdinalMarkers)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION marker_ordinal(kind STRING, number STRING) RETURNS ARRAY<BIGINT> RETURN {ordinal_sql('kind', 'number')}")
