"""Standard normal functions as Spark column expressions.

``norm_ppf`` is the rational approximation of Wichura (1988, Applied
Statistics algorithm AS 241, about 16 digits), evaluated with native
expressions so it runs inside whole-stage code generation; so is ``norm_sf``
(Spark has no ``erfc``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# AS 241 coefficients (numerator a, denominator b for the
# central region; c/d for the intermediate tail; e/f for the far tail),
# highest power first.
A = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
     45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
     133.14166789178437745, 3.387132872796366608)
B = (5226.495278852545925, 28729.085735721942674, 39307.89580009271061,
     21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
     42.313330701600911252, 1.0)
C = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
     1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
     4.6303378461565452959, 1.42343711074968357734)
D = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
     0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
     2.05319162663775882187, 1.0)
E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
     0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
     5.4637849111641143699, 6.6579046435011037772)
G = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
     7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
     0.59983220655588793769, 1.0)


SERIES_TERMS = 40
FRACTION_TERMS = 60


def _horner(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p) -> Column:
    """Inverse standard normal CDF of a probability column (0 < p < 1)."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - F.lit(0.5)
    r_c = F.lit(0.180625) - q * q
    central = q * _horner(A, r_c) / _horner(B, r_c)
    tail_p = F.when(q < 0, p).otherwise(F.lit(1.0) - p)
    r = F.sqrt(-F.log(tail_p))
    near = _horner(C, r - F.lit(1.6)) / _horner(D, r - F.lit(1.6))
    far = _horner(E, r - F.lit(5.0)) / _horner(G, r - F.lit(5.0))
    tail = F.when(r <= 5.0, near).otherwise(far)
    signed = F.when(q < 0, -tail).otherwise(tail)
    return F.when(F.abs(q) <= 0.425, central).otherwise(signed)


def norm_sf(z) -> Column:
    """Upper tail 1 - Phi(z), native: the power series of Phi up to |z| = 3, the
    continued fraction of the tail beyond; about 14 digits. NULL and NaN give NULL."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z)
    density = F.exp(-x * x / 2) / F.lit(math.sqrt(2 * math.pi))
    series = F.lit(1.0)
    for k in range(SERIES_TERMS, 0, -1):
        series = F.lit(1.0) + x * x / F.lit(2.0 * k + 1) * series
    fraction = x
    for k in range(FRACTION_TERMS, 0, -1):
        fraction = x + F.lit(float(k)) / fraction
    tail = F.when(x <= 3, F.lit(0.5) - density * x * series).otherwise(F.try_divide(density, fraction))
    return F.when(z.isNotNull() & ~F.isnan(z), F.when(z < 0, F.lit(1.0) - tail).otherwise(tail))
