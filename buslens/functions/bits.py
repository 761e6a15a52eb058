"""Cut signal values out of 64-bit payload words.

The catalogue prepares a *layout* per signal: ``is_le, end_bit, first, shift,
mask, sign_shift, kind, scale, offset, …``. The functions here return SQL expression
text over the words ``_le`` and ``_be``, the payload length ``_bits`` and a
layout whose fields start with a given prefix (``""`` for plain columns,
``"s."`` for a struct ``s``). One text serves one row per signal, arrays of
signals and one column per signal, and hundreds of columns build quickly.
"""

from __future__ import annotations

from buslens.functions.text import float_text_sql, json_number_sql

# How the raw bits of a signal are read.
KIND_INT, KIND_UNSIGNED64, KIND_FLOAT32, KIND_FLOAT64 = 0, 1, 2, 3
ALL_KINDS = frozenset({KIND_INT, KIND_UNSIGNED64, KIND_FLOAT32, KIND_FLOAT64})
FLOAT_KINDS = frozenset({KIND_FLOAT32, KIND_FLOAT64})
TWO_POW_64 = "18446744073709551616"
LOW_HALVES = 0x0F0F0F0F0F0F0F0F


def complete_sql(s: str) -> str:
    """The signal ends inside the bytes present."""
    return f"coalesce({s}end_bit <= _bits, false)"


def raw_sql(s: str, far: bool = True) -> str:
    """Raw bits, sign-extended where signed.

    ``far`` adds the code for signals that end beyond the first 8 bytes, which
    are cut from the payload ``data`` itself.
    """
    word = f"CASE WHEN {s}is_le THEN _le ELSE _be END"
    unsigned = f"shiftrightunsigned({word}, {s}shift) & {s}mask"
    if far:
        unsigned = f"CASE WHEN {s}end_bit <= 64 THEN {unsigned} ELSE {far_sql(s)} END"
    return f"shiftright(shiftleft({unsigned}, {s}sign_shift), {s}sign_shift)"


def far_sql(s: str) -> str:
    """Unsigned bits of a signal in the 8 bytes from byte ``first`` on, and one more.

    A signal of 64 bits that does not begin with a byte reaches into a ninth.
    """
    digits = f"rpad(hex(substring(data, {s}first + 1, 8)), 16, '0')"
    ninth = f"coalesce(CAST(conv(hex(substring(data, {s}first + 9, 1)), 16, 10) AS BIGINT), 0L)"
    forward = f"CAST(conv({digits}, 16, -10) AS BIGINT)"
    # Reversed digits are the reversed bytes, each with its halves swapped.
    backward = f"CAST(conv(reverse({digits}), 16, -10) AS BIGINT)"
    swapped = f"(shiftleft({backward} & {LOW_HALVES}L, 4) | (shiftrightunsigned({backward}, 4) & {LOW_HALVES}L))"
    little = f"shiftrightunsigned({swapped}, {s}shift) | CASE WHEN {s}shift = 0 THEN 0L ELSE shiftleft({ninth}, 64 - {s}shift) END"
    big = (
        f"CASE WHEN {s}shift >= 0 THEN shiftrightunsigned({forward}, {s}shift)"
        f" ELSE shiftleft({forward}, -{s}shift) | shiftrightunsigned({ninth}, 8 + {s}shift) END"
    )
    return f"(CASE WHEN {s}is_le THEN {little} ELSE {big} END) & {s}mask"


def value_sql(s: str, raw: str, kinds: frozenset[int] = ALL_KINDS) -> str:
    """``raw * scale + offset`` as DOUBLE, null for a null raw value.

    ``kinds`` are the kinds that occur in the catalogue; branches for others
    are not generated.
    """
    readers = {
        KIND_INT: f"CAST({raw} AS DOUBLE)",
        KIND_UNSIGNED64: unsigned_sql(raw),
        KIND_FLOAT32: ieee_sql(raw, exponent_bits=8, fraction_bits=23),
        KIND_FLOAT64: ieee_sql(raw, exponent_bits=11, fraction_bits=52),
    }
    first, *others = sorted(kinds) or [KIND_INT]
    branches = "".join(f" WHEN {kind} THEN {readers[kind]}" for kind in others)
    number = f"CASE {s}kind{branches} ELSE {readers[first]} END" if others else readers[first]
    return f"({number}) * {s}scale + {s}offset"


def unsigned_sql(raw: str) -> str:
    """A BIGINT read as unsigned 64-bit number, correctly rounded to DOUBLE."""
    half = f"shiftrightunsigned({raw}, 1) | ({raw} & 1L)"
    return f"CASE WHEN {raw} >= 0 THEN CAST({raw} AS DOUBLE) ELSE CAST({half} AS DOUBLE) * 2.0D END"


def ieee_sql(raw: str, exponent_bits: int, fraction_bits: int) -> str:
    """An IEEE 754 number from its bits."""
    top = (1 << exponent_bits) - 1
    bias = top >> 1
    sign = f"(CASE WHEN shiftrightunsigned({raw}, {exponent_bits + fraction_bits}) & 1L = 1L THEN -1.0D ELSE 1.0D END)"
    exponent = f"(shiftrightunsigned({raw}, {fraction_bits}) & {top}L)"
    fraction = f"CAST({raw} & {(1 << fraction_bits) - 1}L AS DOUBLE)"
    tiny = f"power(2.0D, {1 - bias - fraction_bits}.0D)"
    scale = f"power(2.0D, {exponent} - {bias}.0D)"
    return (
        f"CASE WHEN {raw} IS NULL THEN CAST(NULL AS DOUBLE)"
        f" WHEN {exponent} = {top}L AND {fraction} > 0D THEN double('NaN')"
        f" WHEN {exponent} = {top}L THEN {sign} * double('Infinity')"
        f" WHEN {exponent} = 0L THEN {sign} * {fraction} * {tiny}"
        f" ELSE {sign} * ({fraction} / {1 << fraction_bits}.0D + 1.0D) * {scale} END"
    )


def label_sql(s: str, raw: str) -> str:
    """Text of the value table for the raw value, null without one."""
    return f"CASE WHEN {s}choices IS NOT NULL THEN element_at({s}choices, {raw}) END"


def integer_text_sql(s: str, raw: str) -> str:
    """Exact text of ``raw * scale + offset`` for integers beyond 2^53."""
    exact = f"CAST({raw} AS DECIMAL(20,0))"
    wrapped = f"CASE WHEN {s}kind = {KIND_UNSIGNED64} AND {raw} < 0 THEN {TWO_POW_64}BD ELSE 0BD END"
    scale, offset = (f"CAST({s}{c} AS DECIMAL(17,0))" for c in ("scale", "offset"))
    return f"CAST(({exact} + {wrapped}) * {scale} + {offset} AS STRING)"


def number_text_sql(s: str, raw: str, value: str, traits) -> str:
    """Exact integer or shortest decimal text of a signal."""
    text = float_text_sql(value, special=bool(traits.kinds & FLOAT_KINDS))
    if traits.integers:
        text = f"CASE WHEN {s}is_integer THEN CAST(try_cast({value} AS BIGINT) AS STRING) ELSE {text} END"
    if traits.long_integers:
        text = f"CASE WHEN {s}is_long_integer THEN {integer_text_sql(s, raw)} ELSE {text} END"
    return text


def text_sql(s: str, raw: str, value: str, traits) -> str:
    """Label, or number as text."""
    text = number_text_sql(s, raw, value, traits)
    return f"coalesce({label_sql(s, raw)}, {text})" if traits.labelled else text


def json_sql(s: str, raw: str, number: str, traits) -> str:
    """Label as JSON string, or number as JSON; ``number`` is its text."""
    value = json_number_sql(number)
    label = f"CASE WHEN {s}choices_json IS NOT NULL THEN element_at({s}choices_json, {raw}) END"
    return f"coalesce({label}, {value})" if traits.labelled else value
