"""Descriptors of attribution maps, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.arrays import total


def energy_top(cam: Column, share: float = 0.10) -> Column:
    """Mass of the hottest ``share`` of the cells over the whole mass; 0 without mass."""
    k = F.greatest(F.lit(1), F.floor(F.size(cam) * share).cast("int"))
    return F.coalesce(F.try_divide(total(F.slice(F.sort_array(cam, asc=False), 1, k)), total(cam)), F.lit(0.0))


def map_entropy(cam: Column) -> Column:
    """Entropy of the normalised map over ln(cells); 1 without mass."""
    mass = total(cam)
    p = F.transform(cam, lambda x: x / mass)
    h = -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))
    return F.when(mass > 0, h / F.ln(F.size(cam))).otherwise(1.0)


def agreement(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Intersection over union of the cells at or above the threshold; 0 if none."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x >= threshold) & (y >= threshold), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    some = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x >= threshold) | (y >= threshold), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(both, some), F.lit(0.0))


def border_mass(cam: Column, height: int, width: int, ring: float = 0.15) -> Column:
    """Share of the mass in the outer ring; 0 without mass."""
    bh, bw = max(1, int(height * ring)), max(1, int(width * ring))
    edge = F.transform(
        cam,
        lambda x, i: F.when((F.floor(i / width) < bh) | (F.floor(i / width) >= height - bh) | (i % width < bw) | (i % width >= width - bw), x).otherwise(0.0),
    )
    return F.coalesce(F.try_divide(total(edge), total(cam)), F.lit(0.0))


def min_max(cam: Column) -> Column:
    """A map stretched to [0, 1]; zeros if it is flat."""
    lo, hi = F.array_min(cam), F.array_max(cam)
    return F.transform(cam, lambda x: F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0)))
