"""Hash expressions shared by key selection, checksums and digests.

All hashes are md5 based so that an independent SQL engine can recompute them:
``hash60(text)`` is the first 15 hex digits of ``md5(text)`` read as a non-negative
bigint. Per-row text is a length-prefixed concatenation of canonical value texts, so
no two different rows of a table share the text.

Expressions are built as SQL text and parsed once on the JVM (``F.expr``): a row hash
over many columns is one call instead of dozens of driver round trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_TOKEN = "~"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def qi(name: str) -> str:
    """Quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def canonical_sql(expr: str, dtype: T.DataType) -> str:
    """Text of a non-null value: ISO dates, timestamps as integer microseconds since
    the epoch (zone-independent for TIMESTAMP_NTZ and cheaper than formatting), hex
    bytes, JSON for nested values."""
    if isinstance(dtype, T.TimestampNTZType):
        return (
            "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
            f"{expr}) AS STRING)"
        )
    if isinstance(dtype, T.TimestampType):
        return f"CAST(unix_micros({expr}) AS STRING)"
    if isinstance(dtype, T.BinaryType):
        return f"lower(hex({expr}))"
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({expr})"
    return f"CAST({expr} AS STRING)"


def field_sql(expr: str, dtype: T.DataType) -> str:
    """``~`` for NULL, else ``<length>:<text>``."""
    t = canonical_sql(expr, dtype)
    return f"CASE WHEN ({expr}) IS NULL THEN '{NULL_TOKEN}' ELSE concat(CAST(length({t}) AS STRING), ':', {t}) END"


def hash60_sql(text: str) -> str:
    return f"CAST(conv(substring(md5({text}), 1, 15), 16, 10) AS BIGINT)"


def row_text_sql(types: dict[str, T.DataType], columns: list[str], prefix: str = "") -> str:
    parts = [sql_str(prefix)] + [field_sql(qi(c), types[c]) for c in columns]
    return f"concat({', '.join(parts)})"


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def hash60(text: Column) -> Column:
    """First 60 bits of md5(text) as bigint (0 <= h < 2**60)."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def canonical_text(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return F.timestamp_diff("MICROSECOND", epoch, column).cast("string")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def field_text(column: Column, dtype: T.DataType) -> Column:
    """Column form of :func:`field_sql` for computed values."""
    text = canonical_text(column, dtype)
    return F.when(column.isNull(), F.lit(NULL_TOKEN)).otherwise(
        F.concat(F.length(text).cast("string"), F.lit(":"), text)
    )


def row_text(df: DataFrame, columns: list[str], prefix: str = "") -> Column:
    return F.expr(row_text_sql(_types(df), columns, prefix))


def table_prefix(table_name: str, columns: list[str]) -> str:
    """Constant prefix so that a table or column rename changes every row hash."""
    return f"{table_name}|{','.join(columns)}|"


def key_rank_sql(seed: int, salt: str, key: str) -> str:
    return hash60_sql(f"concat({sql_str(f'{seed}:{salt}:')}, CAST({qi(key)} AS STRING))")


def key_rank(seed: int, salt: str, key: Column | str) -> Column:
    """Seeded rank of a key: hash60('<seed>:<salt>:<key>')."""
    if isinstance(key, str):
        return F.expr(key_rank_sql(seed, salt, key))
    return hash60(F.concat(F.lit(f"{seed}:{salt}:"), key.cast("string")))


def display_text(column: Column, dtype: T.DataType) -> Column:
    """Readable text for reports (ISO timestamps with microseconds)."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, TS_FORMAT)
    return canonical_text(column, dtype)


# A 60-bit hash is summed as three 20-bit parts in bigint: exact, codegen-friendly
# (no BigDecimal arithmetic per row) and safe up to 2**43 rows per sum.
PART_BITS = 20
PART_MASK = (1 << PART_BITS) - 1


def hash_parts_sql(h: str) -> tuple[str, str, str]:
    return (
        f"shiftright({h}, {2 * PART_BITS})",
        f"shiftright({h}, {PART_BITS}) & {PART_MASK}",
        f"{h} & {PART_MASK}",
    )


def hash_parts(h: Column) -> tuple[Column, Column, Column]:
    return (
        F.shiftright(h, 2 * PART_BITS),
        F.shiftright(h, PART_BITS).bitwiseAND(F.lit(PART_MASK)),
        h.bitwiseAND(F.lit(PART_MASK)),
    )


def combine_parts_sql(hi: str, mid: str, lo: str) -> str:
    """Exact total of the three part sums, as text ('0' for an empty sum)."""
    d = "DECIMAL(38,0)"
    return (
        f"CAST(CAST(CAST(coalesce({hi}, 0) AS {d}) * CAST({1 << (2 * PART_BITS)} AS {d}) "
        f"+ CAST(coalesce({mid}, 0) AS {d}) * CAST({1 << PART_BITS} AS {d}) "
        f"+ CAST(coalesce({lo}, 0) AS {d}) AS {d}) AS STRING)"
    )


def combine_parts(hi: Column, mid: Column, lo: Column) -> Column:
    dec = "decimal(38,0)"
    total = (
        F.coalesce(hi, F.lit(0)).cast(dec) * F.lit(1 << (2 * PART_BITS)).cast(dec)
        + F.coalesce(mid, F.lit(0)).cast(dec) * F.lit(1 << PART_BITS).cast(dec)
        + F.coalesce(lo, F.lit(0)).cast(dec)
    )
    return total.cast("decimal(38,0)").cast("string")
