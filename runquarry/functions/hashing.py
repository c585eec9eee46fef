"""Hash-based randomness.

A draw depends only on the seed and the row's own key, never on partitioning or row order, so a lost
executor or another shuffle width gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TWO_POW_48 = float(2**48)


def _joined(*parts) -> Column:
    def escaped(text: Column) -> Column:
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
        return F.coalesce(text, F.lit("\\N"))

    return F.concat_ws(":", *[escaped(p.cast("string")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def hash_key(*parts) -> Column:
    """md5 of the parts joined by ``:`` (strings and numbers are literals, columns are columns).

    Different parts give different texts: in a column ``:`` and a backslash are escaped by one, and NULL is ``\\N``.
    """
    return F.md5(_joined(*parts))


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) with 48 random bits."""
    return F.conv(F.substring(hash_key(*parts), 1, 12), 16, 10).cast("bigint") / F.lit(_TWO_POW_48)


def hash_int(modulus: int, *parts) -> Column:
    """Integer in [0, modulus)."""
    return F.conv(F.substring(hash_key(*parts), 1, 12), 16, 10).cast("bigint") % F.lit(modulus)
