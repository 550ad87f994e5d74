"""Numerical kernels: pure numpy, no Spark."""
