"""Indicator operators, one module per family; importing the package fills the registry."""

from barloom.operators import averages, hybrid, momentum, oscillators, patterns, statistics, volatility, volume, zigzag  # noqa: F401
