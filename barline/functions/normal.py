"""Standard normal distribution and a portable integer hash, as Spark columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail, highest power first.
_NUM = (
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
_DEN = (
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
_SQRT_2PI = 2.5066282746310002
# Acklam's quantile approximation, highest power first.
_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
_P_LOW = 0.02425


def _poly(x: Column, coefs) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with the value bound once, so a large input is not repeated
    at each use in the expression tree."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_cdf(x: Column) -> Column:
    """P(Z <= x), absolute error around 1e-15."""

    def body(v: Column) -> Column:
        a = F.abs(v)
        e = F.exp(-a * a / 2.0)
        near = e * _poly(a, _NUM) / _poly(a, _DEN)
        b = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
        tail = F.when(a > 37.0, F.lit(0.0)).when(a < 7.07106781186547, near).otherwise(e / b / F.lit(_SQRT_2PI))
        return F.when(v > 0, 1.0 - tail).otherwise(tail)

    return let(x, body)


def _ppf_start(p: Column) -> Column:
    q = F.sqrt(-2.0 * F.log(F.least(p, 1.0 - p)))
    r = p - 0.5
    tail = let(q, lambda v: _poly(v, _C) / _poly(v, _D))
    mid = _poly(r * r, _A) * r / _poly(r * r, _B)
    return F.when(p < _P_LOW, tail).when(p > 1.0 - _P_LOW, -tail).otherwise(mid)


def norm_ppf(p: Column) -> Column:
    """Normal quantile of 0 < p < 1: rational start and one Newton step."""

    def newton(pair: Column) -> Column:
        x0 = pair["x"]
        return x0 - (norm_cdf(x0) - pair["p"]) * F.lit(_SQRT_2PI) * F.exp(x0 * x0 / 2.0)

    def body(v: Column) -> Column:
        start = F.struct(v.alias("p"), _ppf_start(v).alias("x"))
        return F.when((v > 0) & (v < 1), let(start, newton))

    return let(p.cast("double"), body)


# Fixed value: the Mersenne prime 2^31 - 1.
PRIME = 2_147_483_647


def _mixed(a, b, seed: int):
    """The arithmetic of ``portable_hash``, on columns and on numpy integers alike."""
    m = PRIME
    u = (a * 48271 + b * 69621 + (seed * 16807 + 101)) % m
    v = (a * 40692 + b * 39373 + (seed * 48271 + 4099)) % m
    h = (u * v + b) % m
    return (((h + u) % m) * ((h + v) % m) + a) % m


def _folded(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same remainder by ``PRIME``: bits from the 31st on count as those from the first on. Changes x."""
    high = x >> 31
    x &= PRIME
    x += high
    return x


def _mixed_numpy(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """``_mixed`` without divisions: what is multiplied stays under 2^31 + 8, the product under 2^63."""
    u = _folded(_folded(a * 48271 + b * 69621 + (seed * 16807 + 101)))
    v = _folded(_folded(a * 40692 + b * 39373 + (seed * 48271 + 4099)))
    h = u * v
    h += b
    h = _folded(_folded(h))
    u += h
    v += h
    u = _folded(u)
    u *= _folded(v)
    u += a
    u = _folded(_folded(u))
    u -= PRIME * (u >= PRIME)
    return u


def portable_hash(a, b, seed: int):
    """Hash of two non-negative integers to [0, 2^31 - 1), of columns or of numpy arrays.

    Plain 64-bit integer arithmetic, so any SQL engine gives the same draw and a
    retried task repeats it. ``portable_hash_sql`` is the same rule as SQL text.
    """
    if isinstance(a, Column) or isinstance(b, Column):
        return _mixed(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"), seed)
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    # what is negative or large, or a single number, goes by the rule itself
    plain = a.size and b.size and a.ndim + b.ndim and 0 <= seed < 1 << 40 and min(a.min(), b.min()) >= 0 and max(a.max(), b.max()) < 1 << 44
    return _mixed_numpy(a, b, seed) if plain else _mixed(a, b, seed)


def portable_hash_sql(a: str, b: str, seed: int) -> str:
    m = PRIME
    u = f"((({a})::BIGINT * 48271 + ({b})::BIGINT * 69621 + {seed * 16807 + 101}) % {m})"
    v = f"((({a})::BIGINT * 40692 + ({b})::BIGINT * 39373 + {seed * 48271 + 4099}) % {m})"
    h = f"(({u} * {v} + ({b})::BIGINT) % {m})"
    return f"(((({h} + {u}) % {m}) * (({h} + {v}) % {m}) + ({a})::BIGINT) % {m})"


#: how far apart the seeds of the two halves of a wide hash are
_WIDE = 104_729


def wide_hash(a, b, seed: int):
    """Hash of two non-negative integers to [0, (2^31 - 1)^2), about 62 bits; as ``portable_hash``."""
    return portable_hash(a, b, seed) * PRIME + portable_hash(a, b, seed + _WIDE)


def wide_hash_sql(a: str, b: str, seed: int) -> str:
    return f"({portable_hash_sql(a, b, seed)} * {PRIME} + {portable_hash_sql(a, b, seed + _WIDE)})"


def uniform(a: Column, b: Column, seed: int) -> Column:
    """Uniform double in [0, 1) from ``portable_hash``."""
    return portable_hash(a, b, seed) / F.lit(float(PRIME))
