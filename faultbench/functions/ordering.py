"""Order-preserving packing of (timestamp, integer key) into one decimal(38,0).

``max(struct(ts, key))`` picks "latest by (ts, key)" but a struct buffer forces a
sort-based aggregate. Packing both into a decimal keeps the aggregate hash-based
(decimal buffers are fixed width), so partial aggregation on the map side still
collapses a hot group:

    packed = (micros(ts) + 2**61) * 2**64 + (key + 2**63)

NULL timestamps pack as the smallest value (like NULLs in struct ordering). Valid for
|micros| < 2**61 (about 73,000 years) and any bigint key; the result is < 2**126.
"""

from __future__ import annotations

from pyspark.sql import types as T

from faultbench.functions.hashing import qi

TS_OFFSET = 1 << 61
KEY_OFFSET = 1 << 63
SHIFT = 1 << 64
_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros_sql(ts: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.TimestampNTZType):
        return f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, {ts})"
    if isinstance(dtype, T.TimestampType):
        return f"unix_micros({ts})"
    if isinstance(dtype, T.DateType):
        return f"CAST(unix_date({ts}) AS BIGINT) * 86400000000"
    raise TypeError(f"cannot order by {dtype.simpleString()}")


def pack_sql(ts: str, ts_type: T.DataType, key: str) -> str:
    m = micros_sql(qi(ts), ts_type)
    return (
        f"(CAST(coalesce({m}, -{TS_OFFSET}) + {TS_OFFSET} AS DECIMAL(20,0)) * "
        f"CAST({SHIFT} AS DECIMAL(21,0)) + (CAST({qi(key)} AS DECIMAL(20,0)) + "
        f"CAST({KEY_OFFSET} AS DECIMAL(20,0))))"
    )


def unpack_key_sql(packed: str) -> str:
    return f"CAST(({packed} % CAST({SHIFT} AS DECIMAL(21,0))) - CAST({KEY_OFFSET} AS DECIMAL(20,0)) AS BIGINT)"


def unpack_ts_sql(packed: str, ts_type: T.DataType) -> str:
    micros = f"(CAST({packed} DIV CAST({SHIFT} AS DECIMAL(21,0)) AS BIGINT) - {TS_OFFSET})"
    if isinstance(ts_type, T.TimestampNTZType):
        ts = f"timestampadd(MICROSECOND, {micros}, {_EPOCH_NTZ})"
    elif isinstance(ts_type, T.TimestampType):
        ts = f"timestamp_micros({micros})"
    else:
        ts = f"date_from_unix_date(CAST({micros} DIV 86400000000 AS INT))"
    return f"CASE WHEN {micros} = -{TS_OFFSET} THEN NULL ELSE {ts} END"


def packable(ts_type: T.DataType, key_type: T.DataType) -> bool:
    return isinstance(ts_type, (T.TimestampNTZType, T.TimestampType, T.DateType)) and isinstance(
        key_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    )
