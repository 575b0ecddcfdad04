"""Draws that depend on a key alone: any engine with MD5 gives the same ones, and a lost task draws them again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of the key's parts, joined by ``-``."""
    text = F.concat_ws("-", *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def shuffle_key(*key: Column) -> Column:
    """What rows are ordered by in a random permutation."""
    return F.md5(F.concat_ws("-", *[k.cast("string") for k in key]).cast("binary"))
