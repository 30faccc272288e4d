"""Column statistics in one pass: the input for control candidates.

One aggregate over the table computes, for every column, the row count, null count,
minimum and maximum (as canonical text); approximate distinct counts are optional
(HyperLogLog, bounded memory per column). No per-column jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultbench.functions.hashing import display_text as canonical_text

_ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def column_profile(df: DataFrame, *, approx_distinct: bool = False) -> DataFrame:
    entries = []
    for f in df.schema.fields:
        c = F.col(f.name)
        ordered = isinstance(f.dataType, _ORDERED)
        fields = [
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count(F.lit(1)).alias("row_count"),
            F.count(F.when(c.isNull(), 1)).alias("null_count"),
            (canonical_text(F.min(c), f.dataType) if ordered else F.lit(None).cast("string")).alias("min_value"),
            (canonical_text(F.max(c), f.dataType) if ordered else F.lit(None).cast("string")).alias("max_value"),
        ]
        if approx_distinct:
            fields.append(F.approx_count_distinct(c).alias("approx_distinct"))
        entries.append(F.struct(*fields))
    return df.agg(F.array(*entries).alias("p")).select(F.explode("p").alias("p")).select("p.*")
