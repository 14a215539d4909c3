"""Fitting values into declared columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _continues(raw: Column, at: int) -> Column:
    """Whether the byte at place ``at`` (from 1) continues a character."""
    byte = F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
    return F.coalesce(byte.between(0x80, 0xBF), F.lit(False))


def byte_prefix(value: Column, most: int) -> Column:
    """The longest prefix of whole characters that takes ``most`` UTF-8 bytes or fewer.

    Only the bytes around the cut are looked at, so the cost does not grow with
    the value.
    """
    raw = value.cast("binary")
    cut = F.lit(most)
    # a cut before a continuing byte moves back to where its character begins
    for back in (3, 2, 1):
        if most - back >= 0:
            inside = _continues(raw, most + 1)
            for k in range(back - 1):
                inside = inside & _continues(raw, most - k)
            cut = F.when(inside & ~_continues(raw, most - back + 1), most - back).otherwise(cut)
    return F.when(F.octet_length(value) <= most, value).otherwise(F.substring(raw, F.lit(1), cut).cast("string"))


def fit(value: Column, most: int, *, unicode: bool = True, fixed: bool = False) -> Column:
    """``value`` cut to ``most`` characters (bytes where not ``unicode``), and padded with blanks to just that where ``fixed``."""
    if unicode:
        cut = F.left(value, F.lit(most))
        return F.rpad(cut, most, " ") if fixed else cut
    cut = byte_prefix(value, most)
    return F.concat(cut, F.repeat(F.lit(" "), F.lit(most) - F.octet_length(cut))) if fixed else cut
