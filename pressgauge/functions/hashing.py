"""Seeded order-independent ranks: the hash of an id is the same on every run and every cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(seed: int, *parts: Column) -> Column:
    """SHA-256 of `seed::part::part…` as hex text; compare as text."""
    return F.sha2(F.concat_ws("::", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def hash_bin(hashed: Column, hex_digits: int = 3) -> Column:
    """Leading digits of a hash: an order-preserving bin number in [0, 16^digits)."""
    return F.conv(F.substring(hashed, 1, hex_digits), 16, 10).cast("int")


#: places of a hash that its share of all hashes is read from
_SHARE_DIGITS = 12


def hash_share(hashed: Column) -> Column:
    """Where a `stable_hash` lies among all hashes, from 0 to 1, in their order."""
    return F.conv(F.substring(hashed, 1, _SHARE_DIGITS), 16, 10).cast("double") / float(16**_SHARE_DIGITS)
