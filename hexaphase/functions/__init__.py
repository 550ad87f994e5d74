"""Column functions: angles, levels, medians, choices on the circle."""

from . import columns

__all__ = ["columns"]
