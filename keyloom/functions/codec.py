"""Order-preserving key encodings, prefix arithmetic and serial numbers, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_KEY_BYTES = 1 << 20
MAX_NAME_BYTES = 56
BIG_VALUE_BYTES = 4096
SERIAL_SPAN = (1 << 32) - 1
_SIGN = -(1 << 63)


def prefix_succ(prefix: bytes | str) -> bytes | str | None:
    """The least key above every key that starts with prefix; None if there is no such bound."""
    if isinstance(prefix, str):
        for i in range(len(prefix) - 1, -1, -1):
            c = ord(prefix[i])
            if c < 0x10FFFF:
                return prefix[:i] + chr(0xE000 if c + 1 == 0xD800 else c + 1)
        return None
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def encode_long(c: Column) -> Column:
    """8 bytes, big-endian with the sign bit flipped: byte order is numeric order."""
    return F.unhex(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(_SIGN))), 16, "0"))


def encode_string(c: Column) -> Column:
    """UTF-8 with 00 escaped as 00 FF and 00 00 at the end: parts of a composite key stay in order."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), 1)
    return F.unhex(F.concat(F.array_join(F.transform(pairs, lambda b: F.when(b == "00", F.lit("00FF")).otherwise(b)), ""), F.lit("0000")))


def encode_key(*parts: tuple[Column, str]) -> Column:
    """A composite binary key of (column, 'long' | 'string' | 'binary' for the last) parts, in the parts' order."""
    made = []
    for i, (c, kind) in enumerate(parts):
        if kind == "long":
            made.append(encode_long(c))
        elif kind == "string":
            made.append(encode_string(c))
        elif kind == "binary" and i == len(parts) - 1:
            made.append(c.cast("binary"))
        else:
            raise ValueError(f"part {i}: {kind}")
    return F.concat(*made) if len(made) > 1 else made[0]


def encode_value(*columns: str) -> Column:
    """Columns as a JSON value; missing fields are kept as nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary")


def padded(c: Column, width: int) -> Column:
    """A zero-padded decimal key."""
    return F.lpad(c.cast("string"), width, "0")


def is_big(value: Column) -> Column:
    return F.octet_length(value) > BIG_VALUE_BYTES


def valid_key(key: Column) -> Column:
    return key.isNotNull() & (F.octet_length(key) <= MAX_KEY_BYTES)


def checked(kv: DataFrame) -> DataFrame:
    """kv whose rows fail at run time on a null or oversized key."""
    ok = valid_key(F.col("key"))
    return kv.withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(F.lit("KeyTooBig: key is null or over 1048576 bytes")).cast(kv.schema["key"].dataType)))


def serial_add(s: Column, n: Column | int) -> Column:
    """Serial number addition modulo 2^32 - 1 over 1 .. 2^32 - 1: 0 is never reached."""
    return F.pmod(s.cast("long") + (n if isinstance(n, Column) else F.lit(n)) - 1, F.lit(SERIAL_SPAN)) + 1


def serial_diff(a: Column, b: Column) -> Column:
    """Signed distance from b to a, taken as 32-bit numbers that wrap."""
    d = F.pmod(a.cast("long") - b.cast("long"), F.lit(1 << 32))
    return F.when(d >= 1 << 31, d - (1 << 32)).otherwise(d)


def serial_less(a: Column, b: Column) -> Column:
    """Whether a precedes b on the circle of serial numbers."""
    return serial_diff(a, b) < 0
