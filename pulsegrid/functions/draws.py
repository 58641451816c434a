"""Random draws as pure functions of (seed, draw, unit): the same on any partitioning or retry, and in any engine that
has md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _digest(seed: int, *keys: Column) -> Column:
    """md5 of the seed and the keys as text, joined by |."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def rademacher(seed: int, *keys: Column) -> Column:
    """1 where the first hex digit is below 8, else -1."""
    return F.when(_digest(seed, *keys) < "8", 1.0).otherwise(-1.0)


def pick(seed: int, n: Column, *keys: Column) -> Column:
    """An integer in 0 .. n-1, from the first twelve hex digits."""
    return F.pmod(F.conv(F.substring(_digest(seed, *keys), 1, 12), 16, 10).cast("long"), n.cast("long")).cast("int")


def draw_numbers(count: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(count)))
