"""A feed-forward network with ReLU layers and one logistic output, trained by Adam with early stopping."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Defaults of the usual implementation.
RATE, DECAY, BATCH, HELD, PATIENCE, LEAST_GAIN = 1e-3, 1e-4, 200, 0.1, 10, 1e-4
ROWS = 1 << 14


@dataclass
class Network:
    weights: list[np.ndarray]
    biases: list[np.ndarray]

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i < len(self.weights) - 1 else 1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; the layers of some rows are there at a time."""
        parts = [self.layers(x[start : start + ROWS])[-1][:, 0] for start in range(0, max(1, len(x)), ROWS)]
        return np.concatenate(parts)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss and its penalty: weights, then biases."""
    found = net.layers(x)
    delta = (found[-1] - y[:, None]) / len(x)
    weights, biases = [], []
    for i in reversed(range(len(net.weights))):
        weights.append(found[i].T @ delta + DECAY * net.weights[i] / len(x))
        biases.append(delta.sum(0))
        if i:
            delta = (delta @ net.weights[i].T) * (found[i] > 0)
    return weights[::-1] + biases[::-1]


def fit(x: np.ndarray, y: np.ndarray, hidden: list[int], epochs: int, seed: int) -> Network:
    """Best of the epochs by accuracy on a held tenth; ends when that has not risen for ten epochs."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = np.split(order, [int(HELD * len(x))])
    if not len(held):
        held = own
    sizes = [x.shape[1], *hidden, 1]
    bounds = [np.sqrt((2 if n == 1 else 6) / (m + n)) for m, n in zip(sizes, sizes[1:])]
    net = Network(
        [rng.uniform(-b, b, (m, n)) for b, m, n in zip(bounds, sizes, sizes[1:])],
        [rng.uniform(-b, b, n) for b, n in zip(bounds, sizes[1:])],
    )
    values = net.weights + net.biases
    first, second = ([np.zeros_like(v) for v in values] for _ in range(2))
    best, kept, idle, step = -1.0, [v.copy() for v in values], 0, 0
    for _ in range(epochs):
        rng.shuffle(own)
        for start in range(0, len(own), BATCH):
            at = own[start : start + BATCH]
            step += 1
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for v, g, a, b in zip(values, gradients(net, x[at], y[at]), first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= rate * a / (np.sqrt(b) + 1e-8)
        right = float(((net.score(x[held]) > 0.5) == y[held]).mean())
        idle = 0 if right > best + LEAST_GAIN else idle + 1
        if right > best:
            best, kept = right, [v.copy() for v in values]
        if idle > PATIENCE:
            break
    return Network(kept[: len(net.weights)], kept[len(net.weights) :])
