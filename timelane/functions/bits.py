"""Integers out of binary columns and out of packed words.

Every reader returns null when it would pass the end of the bytes, which is the
bounds check. Offsets count from 0 and may be columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 1 << 32
LOW_DIGITS = 0x0F0F0F0F0F0F0F0F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def bytes_at(data: Column, offset, length) -> Column:
    place = (_col(offset) + 1).try_cast("int")
    return F.substring(data, place, _col(length).cast("int"))


def unsigned(data: Column, offset, size: int, little=True) -> Column:
    """Unsigned integer of ``size`` bytes (1 to 4) as bigint, null on a short read."""
    raw = bytes_at(data, offset, size)
    digits = F.when(F.length(raw) == size, F.hex(raw))
    if size == 1 or little is False:
        return _value(digits)
    small = let(reversed_digits(raw, size), lambda v: turned(v, size))
    return F.when(little, small).otherwise(_value(digits)) if isinstance(little, Column) else small


def long_at(data: Column, offset, little) -> Column:
    """Eight bytes in the file's byte order as the 64 bits of a bigint, null on a short read."""
    raw = bytes_at(data, offset, 8)
    small = let(reversed_digits(raw, 8), lambda v: turned(v, 8))
    return F.when(little, small).otherwise(_value(F.when(F.length(raw) == 8, F.hex(raw))))


def reversed_digits(raw: Column, size: int) -> Column:
    """The hex digits of ``size`` bytes read from the last to the first; :func:`turned` makes
    their little-endian number of it."""
    return _value(F.reverse(F.when(F.length(raw) == size, F.hex(raw))))


def turned(value: Column, size: int) -> Column:
    """The two digits of every byte changed over: reversed digits become reversed bytes."""
    low = F.lit(LOW_DIGITS & ((1 << 8 * size) - 1)).cast("bigint")
    return F.shiftleft(value.bitwiseAND(low), 4).bitwiseOR(F.shiftrightunsigned(value, 4).bitwiseAND(low))


def _value(digits: Column) -> Column:
    return F.conv(digits, 16, -10).cast("bigint")


def u8(data, offset) -> Column:
    return unsigned(data, offset, 1)


def u16(data, offset, little=True) -> Column:
    return unsigned(data, offset, 2, little)


def u32(data, offset, little=True) -> Column:
    return unsigned(data, offset, 4, little)


def signed(value: Column, bits: int) -> Column:
    """Two's complement reading of an unsigned value."""
    half = 1 << (bits - 1)
    return F.pmod(value + half, F.lit(1 << bits)) - half


def i16(data, offset, little=True) -> Column:
    return signed(u16(data, offset, little), 16)


def i32(data, offset, little=True) -> Column:
    return signed(u32(data, offset, little), 32)


def has_bit(word: Column, mask: int) -> Column:
    return word.bitwiseAND(F.lit(mask).cast("bigint")) != 0


def field(word: Column, shift: int, mask: int) -> Column:
    """Bits ``(word >> shift) & mask``."""
    moved = F.shiftright(word, shift) if shift else word
    return moved.bitwiseAND(F.lit(mask).cast("bigint"))


def little_hex(value: Column, size: int) -> Column:
    """Little-endian hex digits of an unsigned value, for building binary records."""
    if size == 1:
        return big_hex(value, 1)
    # Digits reversed are bytes reversed with their two digits changed over.
    digits = let(value.cast("bigint"), lambda v: turned(v, size))
    return F.reverse(F.lpad(F.hex(digits), 2 * size, "0"))


def big_hex(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]
