"""Seeded, reproducible pseudo-random columns built on md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_DIGITS = 13  # 13 hex digits are 52 bits, exact in a double
UNIT_RANGE = 16 ** UNIT_DIGITS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_int(digest: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of a digest, from 1-based ``start``, as a bigint."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def md5_of(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[_col(p).cast("string") for p in parts]))


def hash52(seed, *ids) -> Column:
    """Uniform integer in [0, 2^52) from a seed and one or more id columns."""
    return hex_int(md5_of(F.lit(str(seed)), *ids), 1, UNIT_DIGITS)


def uniform(seed, *ids) -> Column:
    """Uniform double in [0, 1) from a seed and one or more id columns."""
    return hash52(seed, *ids) / F.lit(float(UNIT_RANGE))
