"""Keyed random columns.

Every draw is a function of (key, tag, seed) only, so a result does not depend on partitioning and a
recomputed task produces the same rows. md5 is used as a mixing function, not for secrecy; nothing here
is a formal privacy mechanism.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_52 = float(2**52)
TINY = 1e-300


def _col(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def digest(key, tag: str, seed: int = 42) -> Column:
    """32 hex digits mixed from key, tag and seed."""
    return F.md5(F.concat(_col(key).cast("string"), F.lit(f":{tag}:{seed}")))


def uniform_of(hexed: Column, slot: int = 0) -> Column:
    """Uniform in [0, 1) from 13 hex digits of a digest; a digest holds two slots."""
    return F.conv(F.substring(hexed, 1 + 13 * slot, 13), 16, 10).cast("double") / F.lit(TWO_52)


def uniform(key, tag: str, seed: int = 42, slot: int = 0) -> Column:
    return uniform_of(digest(key, tag, seed), slot)


def normal(key, tag: str, seed: int = 42) -> Column:
    """Standard normal by Box-Muller from the two slots of one digest."""
    d = digest(key, tag, seed)
    return F.sqrt(-2.0 * F.ln(1.0 - uniform_of(d, 0))) * F.cos(F.lit(2 * math.pi) * uniform_of(d, 1))


def laplace(key, tag: str, scale, seed: int = 42) -> Column:
    """Laplace(0, scale) by inverse CDF."""
    h = uniform(key, tag, seed) - 0.5
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -scale * F.signum(h) * F.ln(F.greatest(1.0 - 2.0 * F.abs(h), F.lit(TINY)))


def pick(options: list, key, tag: str, seed: int = 42) -> Column:
    """One of a short fixed list, uniformly."""
    at = F.floor(uniform(key, tag, seed) * len(options)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(o) for o in options]), at)


def draw_index(key, tag: str, n: Column, seed: int = 42) -> Column:
    """An index in [0, n)."""
    return F.least(F.floor(uniform(key, tag, seed) * n).cast("long"), n.cast("long") - 1)
