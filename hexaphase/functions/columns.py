"""Column functions: angles, levels, medians of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import GATE_THRESHOLD


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def normalize_deg(x) -> Column:
    """Into [0, 360)."""
    m = F.pmod(_c(x), F.lit(360.0))
    return F.when(m >= 360.0, F.lit(0.0)).otherwise(m)


def circular_distance(a, b) -> Column:
    d = F.pmod(F.abs(_c(a) - _c(b)), F.lit(360.0))
    return F.least(d, 360.0 - d)


def signed_delta(theta, ref) -> Column:
    """theta - ref in [-180, 180)."""
    return F.pmod(_c(theta) - _c(ref) + 180.0, F.lit(360.0)) - 180.0


def nearest_unwrapped(theta, ref) -> Column:
    return _c(ref) + signed_delta(theta, ref)


def power_db(p, eps: float = 1e-12) -> Column:
    return 10.0 * F.log10(F.greatest(_c(p), F.lit(eps)))


def level_db(a) -> Column:
    """Of an amplitude, from -120 dB."""
    return F.greatest(F.lit(-120.0), 20.0 * F.log10(F.greatest(_c(a), F.lit(1e-6))))


def gain_from_db(x) -> Column:
    return F.pow(F.lit(10.0), _c(x) / 20.0)


def mean_db(x, over=None) -> Column:
    """The mean in the power domain."""
    power = F.avg(F.pow(F.lit(10.0), _c(x) / 10.0))
    return 10.0 * F.log10(power.over(over) if over is not None else power)


def robust_z(peak, median, mad) -> Column:
    return (_c(peak) - _c(median)) / F.greatest(1.4826 * _c(mad), F.lit(1e-6))


def is_open(p, threshold: float = GATE_THRESHOLD) -> Column:
    return _c(p) >= threshold


def greedy_circular(items: str, limit: int, separation: float) -> Column:
    """Of an array of structs with a field theta, in order of preference: each at least separation from all taken before, limit at most."""
    return F.expr(
        f"aggregate(slice({items}, 2, size({items})), slice({items}, 1, 1), (acc, x) -> if(size(acc) < {limit} and "
        f"forall(acc, y -> least(pmod(abs(x.theta - y.theta), 360D), 360D - pmod(abs(x.theta - y.theta), 360D)) >= {separation}D), concat(acc, array(x)), acc))"
    )
