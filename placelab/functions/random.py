"""Random numbers from a counter: the same for a row however the table is partitioned or read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # of a digest in hexadecimal: 52 bits, which a double holds exactly


def uniform(seed: int, counter: Column, stream: str = "") -> Column:
    """Evenly spread in the open interval (0, 1), from a digest of seed, stream and counter."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{stream}:"), counter.cast("string")))
    number = F.conv(F.left(digest, F.lit(_DIGITS)), 16, 10).cast("double")
    return (number + 0.5) / float(1 << 4 * _DIGITS)


def gaussian(seed: int, counter: Column, stream: str = "") -> Column:
    """Standard normal by the Box-Muller transform of two uniform numbers."""
    angle = 2 * F.pi() * uniform(seed, counter, f"{stream}b")
    return F.sqrt(-2 * F.ln(uniform(seed, counter, f"{stream}a"))) * F.cos(angle)
