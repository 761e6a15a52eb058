"""Payload bytes as text, as a list and as 64-bit words.

Classic frames carry at most 8 bytes. The usual case is written with plain
arithmetic, which whole-stage code generation compiles; longer payloads take the
slower general expressions so that nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BYTES = 8
# Lengths of flexible-data-rate payloads beyond the classic ones.
FD_LENGTHS = [12, 16, 20, 24, 32, 48, 64]


def spaced_hex(data: Column) -> Column:
    """Upper-case byte pairs separated by one space; empty payload gives ``''``."""
    digits = F.hex(data)
    parts: list[Column] = []
    for i in range(MAX_BYTES):
        parts += [F.substring(digits, 2 * i + 1, 2), F.lit(" ")]
    short = F.rtrim(F.concat(*parts))
    general = F.rtrim(F.regexp_replace(digits, "(..)", "$1 "))
    return F.when(F.length(data) <= MAX_BYTES, short).otherwise(general)


def byte_list(data: Column) -> Column:
    """Payload as an array of ints 0-255."""
    # Latin-1 maps every byte to the character of the same number.
    chars = F.decode(data, "ISO-8859-1")
    cells = [F.ascii(F.substring(chars, i + 1, 1)) for i in range(MAX_BYTES)]
    short = F.slice(F.array(*cells), F.lit(1), F.length(data))
    general = F.transform(
        F.sequence(F.lit(1), F.length(data)), lambda i: F.ascii(F.substring(chars, i, F.lit(1)))
    )
    return F.when(F.length(data) <= MAX_BYTES, short).when(F.length(data) > MAX_BYTES, general)


def big_endian_word(data: Column) -> Column:
    """The first 8 bytes, zero padded, as one BIGINT; byte 0 is the highest."""
    digits = F.rpad(F.hex(data), 16, "0")
    return F.conv(digits, 16, -10).cast("bigint")


def swap_bytes(word: Column) -> Column:
    """Reverse the 8 bytes of a BIGINT, so byte 0 becomes the lowest."""
    for mask, step in ((0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16)):
        up = F.shiftleft(word.bitwiseAND(F.lit(mask)), step)
        down = F.shiftrightunsigned(word, step).bitwiseAND(F.lit(mask))
        word = up.bitwiseOR(down)
    return F.shiftleft(word, 32).bitwiseOR(F.shiftrightunsigned(word, 32))
