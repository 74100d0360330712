"""Key hashes that must give the numbers of well-known protocols, as column expressions without Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_U32 = 0xFFFFFFFF


def _byte_at(data: Column, i: Column) -> Column:
    """Byte ``i``, from 0, of a binary column."""
    return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("bigint")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hash_tag(key: Column) -> Column:
    """What is hashed of a key: between the first ``{`` and the next ``}`` if something is there, else the whole key."""
    inner = F.regexp_extract(key, r"(?s)\A[^{]*\{([^}]+)\}", 1)
    return F.when(inner != "", inner).otherwise(key)


def crc16(data: Column) -> Column:
    """CRC-16/XMODEM of a binary column: polynomial 0x1021, start 0, no reflection."""

    def step(crc: Column, i: Column) -> Column:
        # A whole byte at a time: 0x1021 has its bits at 12, 5 and 0, so the byte comes back shifted by each.
        folded = _let(F.shiftright(crc, 8).bitwiseXOR(_byte_at(data, i)), lambda x: x.bitwiseXOR(F.shiftright(x, 4)))
        return _let(folded, lambda x: F.shiftleft(crc, 8).bitwiseXOR(F.shiftleft(x, 12)).bitwiseXOR(F.shiftleft(x, 5)).bitwiseXOR(x).bitwiseAND(0xFFFF))

    indexes = F.sequence(F.lit(0), F.octet_length(data) - 1)
    return F.when(F.octet_length(data) > 0, F.aggregate(indexes, F.lit(0).cast("bigint"), step)).otherwise(F.lit(0).cast("bigint"))


def hash_slot(key: Column, slots: int = 16384) -> Column:
    return F.pmod(crc16(F.encode(hash_tag(key), "UTF-8")), F.lit(slots)).cast("int")


def _times(a: Column, m: int) -> Column:
    """a * m modulo 2**32 for unsigned a, in two halves that stay within 64 bits."""
    return _let(a, lambda a: (a * (m & 0xFFFF) + F.shiftleft((a * (m >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_U32))


def _mixed(a: Column, shift: int) -> Column:
    return _let(a, lambda a: a.bitwiseXOR(F.shiftrightunsigned(a, shift)))


def _word_at(data: Column, at: Column) -> Column:
    """Four bytes from ``at`` on, the first one lowest; bytes past the end are 0."""
    big = F.conv(F.rpad(F.hex(F.substring(data, at + 1, 4)), 8, "0"), 16, 10).cast("bigint")

    def turned(v: Column) -> Column:
        ends = F.shiftleft(v.bitwiseAND(0xFF), 24).bitwiseOR(F.shiftright(v, 24))
        return ends.bitwiseOR(F.shiftleft(v.bitwiseAND(0xFF00), 8)).bitwiseOR(F.shiftright(v, 8).bitwiseAND(0xFF00))

    return _let(big, turned)


def murmur2(data: Column) -> Column:
    """MurmurHash2, 32 bits, with the seed and constants that message-log clients partition by; unsigned."""
    m, seed = 0x5BD1E995, 0x9747B28C
    n = F.octet_length(data)
    start = F.lit(seed).bitwiseXOR(n.cast("bigint")).bitwiseAND(_U32)
    words = F.floor(n / 4).cast("int")
    places = F.when(words > 0, F.sequence(F.lit(0), F.greatest(words - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    ready = F.transform(places, lambda i: _times(_mixed(_times(_word_at(data, i * 4), m), 24), m))
    h = F.aggregate(ready, start, lambda h, k: _times(h, m).bitwiseXOR(k))
    h = _let(h, lambda h: F.when(n % 4 == 0, h).otherwise(_times(h.bitwiseXOR(_word_at(data, words * 4)), m)))
    return _mixed(_times(_mixed(h, 13), m), 15)


def murmur2_partition(key: Column, partitions: int) -> Column:
    """The partition of a key: the hash without its sign bit, modulo the number of partitions."""
    return F.pmod(murmur2(F.encode(key, "UTF-8")).bitwiseAND(0x7FFFFFFF), F.lit(partitions)).cast("int")
