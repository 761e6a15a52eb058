"""CAN identifiers as text and back."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of an identifier.
HEX_ID = r"^0[xX][0-9a-fA-F]+$"
DECIMAL_ID = r"^[+-]?[0-9]+$"
LARGEST = (1 << 63) - 1


def hex_id(can_id: Column) -> Column:
    """``0x`` plus at least three upper-case hex digits."""
    digits = F.hex(can_id)
    return F.concat(F.lit("0x"), F.when(can_id < 0x100, F.lpad(digits, 3, "0")).otherwise(digits))


def id_from_text(text: Column) -> Column:
    """Hex (``0x…``) or decimal text of any length to a number; null for anything else.

    Numbers beyond a BIGINT are null: no frame has such an identifier.
    """
    token = F.trim(text)
    digits = F.regexp_replace(token, r"^0[xX]0*(?=.)", "")
    number = F.when(F.length(digits) <= 16, F.conv(digits, 16, 10).try_cast("bigint"))
    return F.when(token.rlike(HEX_ID), number).when(token.rlike(DECIMAL_ID), token.try_cast("bigint"))


def parse_id_list(text: str | None) -> list[int]:
    """Comma-separated identifiers; one bad token rejects the whole list."""
    if not text:
        return []
    ids = []
    for token in (part.strip() for part in text.split(",")):
        if re.match(HEX_ID, token):
            ids.append(int(token, 16))
        elif re.match(DECIMAL_ID, token):
            ids.append(int(token))
        else:
            raise ValueError(f"not a CAN ID: {token!r} in {text!r}")
    if any(abs(i) > LARGEST for i in ids):
        raise ValueError(f"a CAN ID is too large in {text!r}")
    return ids
