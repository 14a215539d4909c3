"""The deterministic seed of a value, and the stripping that precedes it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42
#: Longer values are seeded by their beginning and their length.
LONG, KEPT = 10_240, 1_024
#: What Python's str.strip() takes for white space (a fixed value of that language).
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def strip(value: Column) -> Column:
    """``value`` without white space at its ends, Unicode's included."""
    return F.btrim(value, F.lit(WHITESPACE))


def seed_text(value: Column) -> Column:
    """What is hashed for ``value``: itself, or if it is long its first KEPT characters and its length."""
    n = F.char_length(value)
    return F.when(n > LONG, F.concat(F.left(value, F.lit(KEPT)), F.lit("_len_"), n.cast("string"))).otherwise(value)


def seed_u32(value: Column, seed: int = DEFAULT_SEED, salt: str | None = None) -> Column:
    """The first four bytes of SHA-256 over ``seed_value`` (``seed_salt_value`` with a salt) as a bigint; null stays null."""
    lead = f"{seed}_" if salt is None else f"{seed}_{salt}_"
    return F.conv(F.substring(F.sha2(F.concat(F.lit(lead), seed_text(value)), 256), 1, 8), 16, 10).cast("bigint")


def value_hash(value: Column) -> Column:
    """SHA-256 of the value as it is, in binary; that of the text NULL for null."""
    return F.unhex(F.sha2(F.coalesce(value.cast("string"), F.lit("NULL")), 256))
