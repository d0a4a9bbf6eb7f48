"""log-gamma and its derivatives on numpy arrays, for the kernels that run inside tasks."""

from __future__ import annotations

import numpy as np

_SHIFT = 8


def gamma_functions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Γ, digamma and trigamma for x > 0: asymptotic series at x + 8 and the recurrence back."""
    product, first, second = np.ones_like(x), np.zeros_like(x), np.zeros_like(x)
    for k in range(_SHIFT):
        product *= x + k
        first += 1 / (x + k)
        second += 1 / (x + k) ** 2
    z = x + _SHIFT
    i, i2 = 1 / z, 1 / z**2
    log = np.log(z)
    log_gamma = (
        (z - 0.5) * log - z + 0.5 * np.log(2 * np.pi) - np.log(product)
        + i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    )
    digamma = log - i / 2 - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132)))) - first
    trigamma = i + i2 / 2 + i * i2 * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 / 30))) + second
    return log_gamma, digamma, trigamma
