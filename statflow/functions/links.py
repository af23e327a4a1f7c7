"""Links, variances and deviances of generalised linear models, as columns.

The tables of the same names in ``statflow.models.glm`` are their numpy forms. The error function and the
normal quantile are rational approximations (Cody 1969; Wichura 1988, AS 241),
good to about 1e-15, so that probit models stay in the JVM as well.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

_ERF = (
    ([1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3], [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]),
    (
        [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
        [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3],
    ),
    ([1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4], [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]),
)
_PPND = (
    ([2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0], [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301960595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0]),
    ([7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0], [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0]),
    ([2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0], [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0]),
)


def _poly(c: list[float], x: Column) -> Column:
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + F.lit(k)
    return out


def _once(x: Column, body) -> Column:
    """``body(x)`` with ``x`` computed once, however often body uses it."""
    return F.transform(F.array(x), body).getItem(0)


def erf_of(x: np.ndarray) -> np.ndarray:
    """The same error function on arrays."""
    a = np.abs(np.asarray(x, float))
    y, b = a * a, np.maximum(a, 0.46875)
    c = np.maximum(a, 4.0)
    poly = np.polyval
    low = x * poly(_ERF[0][0], np.minimum(y, 0.25)) / poly(_ERF[0][1], np.minimum(y, 0.25))
    mid = np.exp(-b * b) * poly(_ERF[1][0], b) / poly(_ERF[1][1], b)
    z = 1 / (c * c)
    far = np.exp(-c * c) / c * (1 / math.sqrt(math.pi) - z * poly(_ERF[2][0], z) / poly(_ERF[2][1], z))
    return np.where(a <= 0.46875, low, np.sign(x) * (1 - np.where(a <= 4, mid, far)))


def normal_cdf_of(x: np.ndarray) -> np.ndarray:
    return (erf_of(np.asarray(x) / math.sqrt(2)) + 1) / 2


def normal_quantile_of(p: np.ndarray) -> np.ndarray:
    """The normal quantile on arrays; outside (0, 1) not a number."""
    p = np.asarray(p, float)
    poly = np.polyval
    with np.errstate(all="ignore"):
        q = p - 0.5
        r0 = 0.180625 - q * q
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        tail = np.where(r <= 5, poly(_PPND[1][0], r - 1.6) / poly(_PPND[1][1], r - 1.6), poly(_PPND[2][0], r - 5) / poly(_PPND[2][1], r - 5))
        return np.where(np.abs(q) <= 0.425, q * poly(_PPND[0][0], r0) / poly(_PPND[0][1], r0), np.sign(q) * tail)


def erf(x: Column) -> Column:
    return _once(x, _erf)


def _erf(x: Column) -> Column:
    a = F.abs(x)
    y = a * a
    low = x * _poly(_ERF[0][0], y) / _poly(_ERF[0][1], y)
    mid = F.exp(-y) * _poly(_ERF[1][0], a) / _poly(_ERF[1][1], a)
    z = 1 / y
    far = F.exp(-y) / a * (F.lit(1 / math.sqrt(math.pi)) - z * _poly(_ERF[2][0], z) / _poly(_ERF[2][1], z))
    tail = F.when(a <= 4, mid).otherwise(far)
    return F.when(a <= 0.46875, low).otherwise(F.signum(x) * (1 - tail))


def normal_cdf(x: Column) -> Column:
    return (erf(x / math.sqrt(2)) + 1) / 2


def normal_quantile(p: Column) -> Column:
    return _once(p, _quantile)


def _quantile(p: Column) -> Column:
    q = p - 0.5
    r0 = F.lit(0.180625) - q * q
    centre = q * _poly(_PPND[0][0], r0) / _poly(_PPND[0][1], r0)
    near = lambda r: _poly(_PPND[1][0], r - 1.6) / _poly(_PPND[1][1], r - 1.6)
    far = lambda r: _poly(_PPND[2][0], r - 5) / _poly(_PPND[2][1], r - 5)
    tail = _once(F.sqrt(-F.log(F.least(p, 1 - p))), lambda r: F.when(r <= 5, near(r)).otherwise(far(r)))
    return F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * tail)


LINK = {
    "identity": lambda x: x,
    "inverse": lambda x: 1 / x,
    "inverse_squared": lambda x: 1 / (x * x),
    "log": lambda x: F.log(x),
    "logit": lambda x: F.log(x / (1 - x)),
    "cloglog": lambda x: F.log(-F.log(1 - x)),
    "sqrt": lambda x: F.sqrt(x),
    "probit": normal_quantile,
    "cauchit": lambda x: F.tan(math.pi * (x - 0.5)),
}
INVERSE = {
    "identity": lambda x: x,
    "inverse": lambda x: 1 / x,
    "inverse_squared": lambda x: 1 / F.sqrt(x),
    "log": lambda x: F.exp(x),
    "logit": lambda x: 1 / (1 + F.exp(-x)),
    "cloglog": lambda x: 1 - F.exp(-F.exp(x)),
    "sqrt": lambda x: x * x,
    "probit": normal_cdf,
    "cauchit": lambda x: F.atan(x) / math.pi + 0.5,
}
DERIVATIVE = {
    "identity": lambda x: F.lit(1.0),
    "inverse": lambda x: -1 / (x * x),
    "inverse_squared": lambda x: -2 / (x * x * x),
    "log": lambda x: 1 / x,
    "logit": lambda x: 1 / (x * (1 - x)),
    "cloglog": lambda x: -1 / ((1 - x) * F.log(1 - x)),
    "sqrt": lambda x: 1 / (2 * F.sqrt(x)),
    "probit": lambda x: F.lit(math.sqrt(2 * math.pi)) * F.exp(F.pow(normal_quantile(x), 2) / 2),
    "cauchit": lambda x: F.lit(math.pi) / (F.cos(math.pi * (x - 0.5)) * F.cos(math.pi * (x - 0.5))),
}
VARIANCE = {
    "gaussian": lambda x: F.lit(1.0),
    "binomial": lambda x: x * (1 - x),
    "poisson": lambda x: x,
    "exponential": lambda x: x * x,
    "gamma": lambda x: x * x,
    "inverse_gaussian": lambda x: x * x * x,
    "negative_binomial": lambda x: x / ((1 - x) * (1 - x)),
}
DISPERSION = {
    "gaussian": lambda x: x * x,
    "binomial": lambda x: F.lit(1.0),
    "poisson": lambda x: F.lit(1.0),
    "exponential": lambda x: F.lit(1.0),
    "gamma": lambda x: 1 / x,
    "inverse_gaussian": lambda x: x * x,
    "negative_binomial": lambda x: F.lit(1.0),
}


def negative_binomial_variance(x: Column, n: float) -> Column:
    return x + x * x / n


def _ylog(y: Column, ratio: Column) -> Column:
    return F.when(y == 0, F.lit(0.0)).otherwise(y * F.log(ratio))


DEVIANCE = {
    "gaussian": lambda y, m: (y - m) * (y - m),
    "poisson": lambda y, m: 2 * (_ylog(y, y / m) - (y - m)),
    "binomial": lambda y, m: 2 * (_ylog(y, y / m) + _ylog(1 - y, (1 - y) / (1 - m))),
    "gamma": lambda y, m: 2 * (-F.log(y / m) + (y - m) / m),
    "inverse_gaussian": lambda y, m: (y - m) * (y - m) / (m * m * y),
}
