"""The normal distribution as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of W. J. Cody's rational approximation of erfc on [0.5, 4] and beyond (1969).
_P = (3.00459261020161601e2, 4.51918953711872942e2, 3.39320816734343687e2, 1.52989285046940404e2, 4.31622272220567353e1, 7.21175825088309366, 5.64195517478973971e-1, -1.36864857382716707e-7)
_Q = (3.00459260956983293e2, 7.90950925327898027e2, 9.31354094850609621e2, 6.38980264465631167e2, 2.77585444743987643e2, 7.70001529352294730e1, 1.27827273196294235e1, 1.0)
_A = (2.42667955230531775e2, 2.19792616182941524e1, 6.99638348861913550, -3.56098437018153850e-2)
_B = (2.15058875869861201e2, 9.11649054045149012e1, 1.50827976304077870e1, 1.0)
_U = (-2.99610707703542174e-3, -4.94730910623250734e-2, -2.26956593539686930e-1, -2.78661308609647788e-1, -2.23192459734184686e-2)
_V = (1.06209230528467918e-2, 1.91308926107829841e-1, 1.05167510706793207, 1.98733201817135256, 1.0)


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(c)
    return out


def cdf(z: Column) -> Column:
    """P(Z <= z), to about 1e-15, without leaving the JVM."""
    x = F.abs(z) / math.sqrt(2)
    x2 = x * x
    small = 1 - x * _poly(x2, _A) / _poly(x2, _B)
    middle = F.exp(-x2) * _poly(x, _P) / _poly(x, _Q)
    y = 1 / F.greatest(x2, F.lit(1e-300))
    large = F.exp(-x2) / F.greatest(x, F.lit(1e-300)) * (1 / math.sqrt(math.pi) + y * _poly(y, _U) / _poly(y, _V))
    upper = F.when(x < 0.46875, small).when(x < 4, middle).otherwise(large) / 2
    return F.when(z > 0, 1 - upper).otherwise(upper)


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
