"""Estimates from best efforts: oxygen uptake, functional threshold power, threshold heart rate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.scalars import rnd


def vo2max(watts: Column, weight: Column) -> Column:
    """16.6 + 8.87 W/kg of the best five minutes; null unless both are positive."""
    return F.when((watts > 0) & (weight > 0), rnd(16.6 + 8.87 * (watts / weight), 2))


def ftp(watts: Column) -> Column:
    """95 % of the best twenty minutes."""
    return F.when(watts > 0, rnd(watts * 0.95, 2))


def lthr(bpm: Column, factor: float = 0.98) -> Column:
    """98 % of the best twenty minutes' heart rate, whole beats."""
    return F.when(bpm > 0, rnd(bpm * factor, 0))
