"""The little that the numpy networks share."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


class Adam:
    def __init__(self, params: Params, rate: float = 0.005, decay: float = 0.0) -> None:
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            move = (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            self.params[k] -= (self.rate * (move + self.decay * self.params[k])).astype(self.params[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def normal(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return (rng.standard_normal(shape) * (scale if scale is not None else 1 / np.sqrt(shape[0]))).astype(np.float32)
