"""Generated signals."""

from __future__ import annotations

import numpy as np

#: Coefficients of a published filter that turns white noise into 1/f noise.
PINK_B = (0.049922035, -0.095993537, 0.050612699, -0.004408786)
PINK_A = (1.0, -2.494956002, 2.017265875, -0.522189400)


def rpink(n: int, scale: float = 1.0, seed: int | None = None) -> np.ndarray:
    """``n`` samples of pink noise."""
    x = np.random.default_rng(seed).standard_normal(n)
    y = np.zeros(n)
    for i in range(n):
        y[i] = sum(b * x[i - k] for k, b in enumerate(PINK_B) if i >= k) - sum(a * y[i - k] for k, a in enumerate(PINK_A) if k and i >= k)
    return y * scale
