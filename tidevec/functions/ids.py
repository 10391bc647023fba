"""64-bit time-ordered ids: 1 high bit, 27 bits of seconds, 8 bits of ticker, 28 bits of source, kept in a signed BIGINT.

Seconds count from EPOCH_BASE, the high bit is 0 unless given. Both are choices of this library.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Widths of the fields.
SECOND_BITS, TICKER_BITS, SOURCE_BITS = 27, 8, 28
SECOND_SHIFT, TICKER_SHIFT = TICKER_BITS + SOURCE_BITS, SOURCE_BITS
#: 2024-01-01T00:00:00Z.
EPOCH_BASE = 1_704_067_200


def _field(x: Column, bits: int) -> Column:
    return x.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def encode(seconds: Column, ticker: Column, source: Column, high: Column | None = None) -> Column:
    """Pack the fields; what is over a field's width is cut off."""
    out = F.shiftleft(_field(seconds, SECOND_BITS), SECOND_SHIFT).bitwiseOR(F.shiftleft(_field(ticker, TICKER_BITS), TICKER_SHIFT)).bitwiseOR(_field(source, SOURCE_BITS))
    return out if high is None else out.bitwiseOR(F.shiftleft(_field(high, 1), 63))


def seconds_of(id_: Column) -> Column:
    return _field(F.shiftrightunsigned(id_, SECOND_SHIFT), SECOND_BITS)


def ticker_of(id_: Column) -> Column:
    return _field(F.shiftrightunsigned(id_, TICKER_SHIFT), TICKER_BITS)


def source_of(id_: Column) -> Column:
    return _field(id_, SOURCE_BITS)


def high_of(id_: Column) -> Column:
    return F.shiftrightunsigned(id_, 63)


def time_of(id_: Column, epoch_base: int = EPOCH_BASE) -> Column:
    """The id's time as a timestamp."""
    return F.timestamp_seconds(seconds_of(id_) + F.lit(epoch_base))


def unsigned_order(id_: Column) -> Column:
    """Sort key that puts ids with the high bit set after the others."""
    return id_.bitwiseXOR(F.lit(-(1 << 63)))


def cold_key(id_: Column) -> Column:
    """The id without its source."""
    return F.shiftrightunsigned(id_, SOURCE_BITS)


def between_seconds(id_: Column, first: int, end: int) -> Column:
    """Ids (high bit 0) of first <= seconds < end: a plain range, which reaches the Parquet scan."""
    return (id_ >= F.lit(first << SECOND_SHIFT).cast("long")) & (id_ < F.lit(end << SECOND_SHIFT).cast("long"))


def register(spark: SparkSession) -> None:
    """SQL functions tv_id_encode, tv_id_seconds, tv_id_ticker, tv_id_source, tv_id_cold_key and tv_id_order."""
    for name, arguments, body in (
        ("tv_id_encode", "s BIGINT, t BIGINT, src BIGINT", f"shiftleft(s & {(1 << SECOND_BITS) - 1}L, {SECOND_SHIFT}) | shiftleft(t & {(1 << TICKER_BITS) - 1}L, {TICKER_SHIFT}) | (src & {(1 << SOURCE_BITS) - 1}L)"),
        ("tv_id_seconds", "id BIGINT", f"shiftrightunsigned(id, {SECOND_SHIFT}) & {(1 << SECOND_BITS) - 1}L"),
        ("tv_id_ticker", "id BIGINT", f"shiftrightunsigned(id, {TICKER_SHIFT}) & {(1 << TICKER_BITS) - 1}L"),
        ("tv_id_source", "id BIGINT", f"id & {(1 << SOURCE_BITS) - 1}L"),
        ("tv_id_cold_key", "id BIGINT", f"shiftrightunsigned(id, {SOURCE_BITS})"),
        ("tv_id_order", "id BIGINT", "id ^ (-9223372036854775807L - 1L)"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS BIGINT RETURN {body}")
