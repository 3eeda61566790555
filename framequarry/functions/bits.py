"""Bytes as numbers and text, in column expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _off(o: Column | int) -> Column:
    return F.lit(o) if isinstance(o, int) else o


def piece(b: Column | str, off: Column | int, n: Column | int) -> Column:
    """n bytes from a 0-based offset, or null if they do not all exist."""
    b, off, n = _col(b), _off(off), _off(n)
    return F.when((off >= 0) & (off + n <= F.length(b)), F.substring(b, off + 1, n))


def hex_number(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("bigint")


def be(b: Column | str, off: Column | int, n: int) -> Column:
    """Big-endian unsigned integer of n bytes (up to 7 without overflow), null beyond the end."""
    return hex_number(F.hex(piece(b, off, n)))


def le(b: Column | str, off: Column | int, n: int) -> Column:
    """Little-endian unsigned integer of n bytes."""
    return reduce(lambda x, y: x + y, [be(b, _off(off) + i, 1) * (1 << (8 * i)) for i in range(n)])


def u64_bits(b: Column | str, off: Column | int) -> Column:
    """The 64-bit pattern as BIGINT (negative from 2**63 on); compare such values with unsigned_key()."""
    return F.shiftleft(be(b, off, 4), 32).bitwiseOR(be(b, _off(off) + 4, 4))


def unsigned_key(x: Column) -> Column:
    """Orders 64-bit patterns as unsigned numbers."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def to_bytes(x: Column, n: int) -> Column:
    """x as n big-endian bytes."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit((1 << (8 * n)) - 1))), 2 * n, "0"))


def mac_text(b: Column | str) -> Column:
    return F.concat_ws(":", *[F.lower(F.hex(F.substring(_col(b), i, 1))) for i in range(1, 7)])


def ipv4_text(b: Column | str) -> Column:
    b = _col(b)
    return F.when(b.isNotNull(), F.concat_ws(".", *[be(b, i, 1).cast("string") for i in range(4)]))


def ipv6_text(b: Column | str, padded: bool = True) -> Column:
    """Eight groups, never shortened by `::`; zero-padded or not."""
    b = _col(b)
    group = (lambda i: F.lower(F.hex(F.substring(b, 2 * i + 1, 2)))) if padded else (lambda i: F.lower(F.hex(be(b, 2 * i, 2))))
    return F.when(b.isNotNull(), F.concat_ws(":", *[group(i) for i in range(8)]))


def ip_text(b: Column | str) -> Column:
    b = _col(b)
    return F.when(F.length(b) == 4, ipv4_text(b)).when(F.length(b) == 16, ipv6_text(b))


def ipv4_bytes(text: str) -> bytes:
    parts = [int(p) for p in text.split(".")]
    if len(parts) != 4 or any(not 0 <= p <= 255 for p in parts):
        raise ValueError(text)
    return bytes(parts)


def ones_complement_sum(b: Column | str) -> Column:
    """The folded 16-bit ones-complement sum of the bytes (an odd last byte counts as its high half).

    That sum is the bytes as one number, modulo 65535, so three words are added at once. The bytes' hex digits are bound to a name: inside an
    aggregate an expression is worked out again at every step.
    """
    b = _col(b)
    zero = F.lit(0).cast("bigint")
    digits = F.concat(F.hex(b), F.when(F.length(b) % 2 == 1, "00").otherwise(""))

    def step(total: Column, word: Column) -> Column:
        s = total + word
        return F.when(s >= 1 << 61, s % 0xFFFF + 0xFFFF).otherwise(s)

    def summed(h: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(h)), F.lit(12))
        return F.aggregate(places, zero, lambda total, i: step(total, F.coalesce(hex_number(F.substring(h, i, F.lit(12))), zero)))

    total = F.get(F.transform(F.array(digits), summed), F.lit(0))
    folded = F.transform(F.array(total), lambda t: F.when((t % 0xFFFF == 0) & (t > 0), F.lit(0xFFFF).cast("bigint")).otherwise(t % 0xFFFF))
    return F.when(b.isNotNull(), F.get(folded, F.lit(0)))


def checksum_of(b: Column | str) -> Column:
    """RFC 1071 checksum of the bytes."""
    return F.lit(0xFFFF) - ones_complement_sum(b)


def printable_line(b: Column | str) -> Column:
    """The first line as text, other than printable ASCII as a dot."""
    return F.regexp_replace(F.regexp_extract(F.decode(_col(b), "ISO-8859-1"), r"^([^\r\n\x00]*)", 1), r"[^\x20-\x7e]", ".")
