"""Small numpy networks over pooled vectors: a hidden layer of tanh units and a softmax, with a temperature fitted apart."""

from __future__ import annotations

import numpy as np


class Adam:
    def __init__(self, shapes: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.rate, self.decay, self.t = rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in shapes.items()}
        self.v = {k: np.zeros_like(v) for k, v in shapes.items()}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            mean, var = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            params[k] -= (self.rate * (mean / (np.sqrt(var) + 1e-8) + self.decay * params[k])).astype(params[k].dtype)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class TwoLayer:
    """Classes of vectors. ``fit`` keeps a part of the rows (``spare``) for the temperature."""

    def __init__(self, classes: int, hidden: int = 32, seed: int = 11):
        self.classes, self.hidden, self.rng, self.temperature = classes, hidden, np.random.default_rng(seed), 1.0
        self.p: dict[str, np.ndarray] = {}
        self.mean = self.scale = None

    def _logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p["w1"] + self.p["b1"])
        return h, h @ self.p["w2"] + self.p["b2"]

    def fit(self, x: np.ndarray, y: np.ndarray, spare: np.ndarray, epochs: int = 120, batch: int = 64, rate: float = 3e-3) -> TwoLayer:
        own = ~spare if (~spare).any() else np.ones(len(y), dtype=bool)
        x = x.astype(np.float64)
        self.mean = x[own].mean(axis=0) if own.any() else np.zeros(x.shape[1])
        self.scale = (x[own].std(axis=0) if own.any() else np.ones(x.shape[1])) + 1e-3
        z = (x - self.mean) / self.scale
        self.p = {"w1": self.rng.standard_normal((x.shape[1], self.hidden)) / np.sqrt(x.shape[1]), "b1": np.zeros(self.hidden), "w2": np.zeros((self.hidden, self.classes)), "b2": np.zeros(self.classes)}
        share = np.bincount(y[own], minlength=self.classes) + 1.0
        self.p["b2"] = np.log(share / share.sum())
        adam, rows = Adam(self.p, rate, 1e-3), np.flatnonzero(own)
        epochs = min(epochs, max(10, 400_000 // max(len(rows), 1)))
        for _ in range(epochs):
            self.rng.shuffle(rows)
            for s in range(0, len(rows), batch):
                at = rows[s : s + batch]
                h, logits = self._logits(z[at])
                d = (softmax(logits) - np.eye(self.classes)[y[at]]) / len(at)
                back = (d @ self.p["w2"].T) * (1 - h * h)
                adam.step(self.p, {"w2": h.T @ d, "b2": d.sum(axis=0), "w1": z[at].T @ back, "b1": back.sum(axis=0)})
        if spare.any():
            logits, truth = self._logits(z[spare])[1], y[spare]
            loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
            self.temperature = float(min(np.geomspace(0.2, 5.0, 65), key=loss))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, a row per vector; the same for all rows if there was nothing to learn from."""
        z = (x.astype(np.float64) - self.mean) / self.scale
        return softmax(self._logits(z)[1] / self.temperature)
