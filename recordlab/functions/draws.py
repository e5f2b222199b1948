"""Pseudo-random draws that do not depend on partitioning and can be repeated in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *parts: Column | str) -> Column:
    """Hex md5 of ``seed:part:part…``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw(seed: int, *parts: Column | str) -> Column:
    """Integer in [0, 2**60) from the first fifteen hex digits of the digest."""
    return F.conv(F.substring(digest(seed, *parts), 1, 15), 16, 10).cast("bigint")


def digest_bucket(hex_digest: Column, digits: int = 3) -> Column:
    """Leading hex digits as an integer: equal-sized buckets that follow the digest order."""
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("int")
