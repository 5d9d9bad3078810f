"""Random draws keyed by what they are for.

A draw depends on its key alone (seed, scenario, ticker, simulation, day), not on partitions or order, so a
lost task draws the same numbers again, and another engine can check them.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 2.0**52 + 1


def scenario_seed(base: int, name: str) -> int:
    """A seed for a scenario that doesn't change with the process."""
    return (base + int(hashlib.md5(name.encode()).hexdigest(), 16)) % 2**32


def uniform(*key: Column) -> Column:
    """Between 0 and 1, both excluded: 52 bits of the md5 of the key."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(_SPAN)


def normal(*key: Column) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.ln(uniform(*key, F.lit("a")))) * F.cos(F.lit(2 * math.pi) * uniform(*key, F.lit("b")))
