"""Exact kernel models in memory, against which the distributed ones are held."""

import numpy as np


class GaussianProcess:
    """Exact regression on centred targets. scale: the kernel's; None: the likeliest of a grid, with the likeliest variance."""

    def __init__(self, alpha: float = 1e-10, matern: bool = False, scale: float | None = None):
        self.alpha, self.matern, self.fixed = alpha, matern, scale

    def _kernel(self, a, b, scale):
        d = np.sqrt(np.maximum(((a[:, None] - b[None]) ** 2).sum(-1), 0)) / scale
        return (1 + np.sqrt(3) * d) * np.exp(-np.sqrt(3) * d) if self.matern else np.exp(-0.5 * d * d)

    def fit(self, x, y):
        self.mean, self.x = y.mean(), x
        best = None
        grid = np.logspace(-1.5, 1.5, 13) * max(float(np.std(x)), 1e-9) * np.sqrt(x.shape[1]) if self.fixed is None else [self.fixed]
        for scale in grid:
            try:
                low = np.linalg.cholesky(self._kernel(x, x, scale) + (self.alpha + 1e-9) * np.eye(len(x)))
            except np.linalg.LinAlgError:
                continue
            v = np.linalg.solve(low, y - self.mean)
            var = 1.0 if self.fixed is not None else float(v @ v) / len(y) + 1e-30
            score = -0.5 * len(y) * np.log(var) - np.log(np.diag(low)).sum()
            if best is None or score > best[0]:
                best = (score, scale, low, v, var)
        if best is None:
            raise ValueError("kernel matrix not positive definite")
        _, self.scale, self.low, self.v, self.var = best
        return self

    def predict(self, x):
        k = np.linalg.solve(self.low, self._kernel(self.x, x, self.scale))
        return self.mean + k.T @ self.v, np.sqrt(np.maximum(self.var * (1 - (k * k).sum(0)), 0))


class SupportVector:
    """Epsilon-insensitive regression with an RBF kernel: the dual's most violating pair is solved until none violates by tolerance."""

    def __init__(self, c: float = 1.0, gamma: str = "scale", epsilon: float = 0.1, tolerance: float = 1e-3, rounds: int = 200_000):
        self.c, self.gamma, self.epsilon, self.tolerance, self.rounds = c, gamma, epsilon, tolerance, rounds

    def fit(self, x, y):
        n = len(y)
        self.x = x
        self.g = 1 / (x.shape[1] * (x.var() or 1)) if self.gamma == "scale" else 1 / x.shape[1]
        k = self._kernel(x, x)
        sign = np.concatenate([np.ones(n), -np.ones(n)])
        a, slope = np.zeros(2 * n), np.concatenate([self.epsilon - y, self.epsilon + y])
        self.converged = False
        for _ in range(self.rounds):
            pull = -sign * slope
            up = np.where((sign > 0) & (a < self.c) | (sign < 0) & (a > 0), pull, -np.inf)
            down = np.where((sign > 0) & (a > 0) | (sign < 0) & (a < self.c), pull, np.inf)
            i, j = int(np.argmax(up)), int(np.argmin(down))
            if up[i] - down[j] < self.tolerance:
                self.converged = True
                break
            p, q = i % n, j % n
            step = (up[i] - down[j]) / max(k[p, p] + k[q, q] - 2 * k[p, q], 1e-12)
            step = min(step, self.c - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else self.c - a[j])
            a[i] += sign[i] * step
            a[j] -= sign[j] * step
            slope += sign * np.tile(k[:, p] - k[:, q], 2) * step
        self.beta, self.bias = a[:n] - a[n:], float((up[i] + down[j]) / 2)
        return self

    def _kernel(self, a, b):
        return np.exp(-self.g * ((a[:, None] - b[None]) ** 2).sum(-1))

    def predict(self, x):
        return self.bias + self._kernel(x, self.x) @ self.beta, None
