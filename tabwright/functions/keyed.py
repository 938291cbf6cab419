"""Random draws keyed by row identity.

``rand(seed)`` depends on how rows are laid out over partitions and changes when a lost task is rerun
over another layout.  These draws are hashes of the row's own key, so they are the same on every run,
and any other SQL engine with SHA-256 can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
_TWO_52 = float(1 << 52)


def digest(tag: str, *keys: Column, seed: int = SEED) -> Column:
    """64 hex digits from the seed, a tag naming the draw, and the row's key columns."""
    parts = [F.lit(str(seed)), F.lit(tag), *[k.cast("string") for k in keys]]
    return F.sha2(F.concat_ws("|", *parts), 256)


def hex_to_long(h: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(h, start, length), 16, 10).cast("bigint")


def uniform(tag: str, *keys: Column, seed: int = SEED) -> Column:
    """A number strictly between 0 and 1 from 52 hash bits."""
    return (hex_to_long(digest(tag, *keys, seed=seed), 1, 13).cast("double") + F.lit(0.5)) / F.lit(_TWO_52)


def index_below(n, tag: str, *keys: Column, seed: int = SEED) -> Column:
    """A whole number in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(tag, *keys, seed=seed) * n).cast("bigint")


def laplace(scale, tag: str, *keys: Column, seed: int = SEED) -> Column:
    """Laplace(0, scale) by inversion."""
    scale = scale if isinstance(scale, Column) else F.lit(float(scale))
    centred = uniform(tag, *keys, seed=seed) - F.lit(0.5)
    return -scale * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def normal(tag: str, *keys: Column, seed: int = SEED) -> Column:
    """Standard normal by Box and Muller's transform of two keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(tag + ":r", *keys, seed=seed)))
    return radius * F.cos(F.lit(2.0 * 3.141592653589793) * uniform(tag + ":a", *keys, seed=seed))


def pick(values: list[str], tag: str, *keys: Column, seed: int = SEED) -> Column:
    """One entry of a short fixed list."""
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (index_below(len(values), tag, *keys, seed=seed) + 1).cast("int"))


def with_drawn(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    A column of a plain projection is put into every filter and expression that reads it, each time with all its hashes; an
    exploded one-element array stays as it is.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.select("*", F.inline(F.array(fields)))
