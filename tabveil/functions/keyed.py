"""Keyed randomness: the same key and seed give the same number, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def token(c: str | Column) -> Column:
    """A value as text; NULL is told from every string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def uniform(seed: str, *keys: str | Column) -> Column:
    """A number strictly between 0 and 1, an odd multiple of 2 ** -53, from the md5 of the seed and the keys.

    A seed that others know lets them subtract the noise: draw it from secrets for releases, fix it in tests only.
    """
    text = F.concat_ws("|", F.lit(seed), *[token(k) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4503599627370496.0)


def laplace(u: Column, scale: float) -> Column:
    """Laplace noise of a scale by the inverse distribution function."""
    v = u - 0.5
    return F.lit(-float(scale)) * F.signum(v) * F.ln(1 - 2 * F.abs(v))


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u))
