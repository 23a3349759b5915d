"""Quantiles of distributions that Spark has no function for."""

from __future__ import annotations

from math import erf, lgamma
from statistics import NormalDist

import numpy as np


def normal_quantile(p: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return NormalDist(mean, sd).inv_cdf(p)


def central_z(level: float) -> float:
    """Half-width, in standard deviations, of the central interval that holds this share of a normal distribution."""
    return normal_quantile(0.5 + level / 2)


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(erf)(np.asarray(z) / np.sqrt(2)))


def _bisect(cdf, p: np.ndarray, low: float, high: float) -> np.ndarray:
    lo, hi = np.full(p.shape, low), np.full(p.shape, high)
    for _ in range(80):
        mid = (lo + hi) / 2
        up = cdf(mid) < p
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def _integral(density, x: np.ndarray, n: int = 400) -> np.ndarray:
    """Integral from 0 to x by Gauss-Legendre after t = x u^2, which takes poles at 0 away for shapes of 1/2 or more."""
    node, weight = np.polynomial.legendre.leggauss(n)
    u, w = (node + 1) / 2, weight / 2
    t = x[:, None] * u[None, :] ** 2
    return (density(t) * 2 * x[:, None] * u * w).sum(1)


def gamma_quantile(p, shape: float, loc: float = 0.0, scale: float = 1.0) -> np.ndarray:
    p = np.atleast_1d(np.asarray(p, float))
    top = shape + 40 * np.sqrt(shape) + 40
    return loc + scale * _bisect(lambda x: _integral(lambda t: np.exp((shape - 1) * np.log(np.maximum(t, 1e-300)) - t - lgamma(shape)), x), p, 0.0, top)


def beta_quantile(p, a: float, b: float, loc: float = 0.0) -> np.ndarray:
    p = np.atleast_1d(np.asarray(p, float))
    c = lgamma(a + b) - lgamma(a) - lgamma(b)
    density = lambda t: np.exp(c + (a - 1) * np.log(np.maximum(t, 1e-300)) + (b - 1) * np.log(np.maximum(1 - t, 1e-300)))
    return loc + _bisect(lambda x: _integral(density, x), p, 0.0, 1.0)
