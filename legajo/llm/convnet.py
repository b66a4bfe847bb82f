"""A convolutional classifier in numpy: embeddings, filters of several widths, max pooling, softmax.

Sequences lie one after the other in one id array, each behind ``width - 1`` padding ids (0, whose embedding
stays zero) that count as its own, and as many end the array, so no filter sees two of them. The filters of all widths form one matrix, zero where a filter is
narrower than the widest.
"""

from __future__ import annotations

import numpy as np

NAMES = ("table", "conv", "bias", "dense", "out")
#: Ids whose filter values training holds at once.
BLOCK = 1 << 16


class ConvNet:
    def __init__(self, vocabulary: int, dim: int, widths: tuple[int, ...], filters: int, classes: int, seed: int = 7, zero: bool = False):
        rng = np.random.default_rng(seed)
        self.width, self.dim = max(widths), dim
        self.table = np.zeros((vocabulary, dim), np.float32) if zero else rng.normal(0, 0.3, (vocabulary, dim)).astype(np.float32)
        self.table[0] = 0
        self.mask = np.zeros((self.width * dim, filters * len(widths)), np.float32)
        for i, w in enumerate(widths):
            self.mask[: w * dim, i * filters : (i + 1) * filters] = 1
        self.conv = rng.normal(0, 1 / np.sqrt(self.width * dim), self.mask.shape).astype(np.float32) * self.mask
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.dense = rng.normal(0, 0.2, (self.mask.shape[1], classes)).astype(np.float32)
        self.out = np.zeros(classes, np.float32)

    def columns(self, ids: np.ndarray) -> np.ndarray:
        """Row i: the embeddings of ids i to i + width - 1."""
        flat = self.table[ids].reshape(-1)
        n = len(ids) - self.width + 1
        return np.lib.stride_tricks.as_strided(flat, (n, self.width * self.dim), (4 * self.dim, 4))

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Max over each sequence; ``starts``: of the paddings before each. Works in blocks that fit a cache."""
        n = len(ids) - self.width + 1
        out = np.full((len(starts), self.conv.shape[1]), -np.inf, np.float32)
        owner = np.searchsorted(starts, np.arange(0, n, 8192), "right") - 1
        for k, a in enumerate(range(0, n, 8192)):
            b = min(n, a + 8192)
            value = self.columns(ids[a : b + self.width - 1]) @ self.conv
            last = np.searchsorted(starts, b, "left")
            cuts = np.maximum(starts[owner[k] : last] - a, 0)
            out[owner[k] : last] = np.maximum(out[owner[k] : last], np.maximum.reduceat(value, cuts))
        return out + self.bias

    def maxima(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max over each sequence and where it was taken; ``starts`` end with the end of the last one. Long sequences go by blocks."""
        best, where = [], []
        if len(ids) <= BLOCK:
            value = self.columns(ids) @ self.conv + self.bias
            where = np.stack([a + value[a:b].argmax(0) for a, b in zip(starts[:-1], starts[1:], strict=True)])
            return np.take_along_axis(value, where, 0), where
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            most, at = np.full(self.conv.shape[1], -np.inf, np.float32), np.zeros(self.conv.shape[1], np.int64)
            for c in range(a, b, BLOCK):
                value = self.columns(ids[c : min(b, c + BLOCK) + self.width - 1]) @ self.conv + self.bias
                k = value.argmax(0)
                found = value[k, np.arange(len(k))]
                at, most = np.where(found > most, c + k, at), np.maximum(most, found)
            best.append(most)
            where.append(at)
        return np.stack(best), np.stack(where)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.dense + self.out
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, sequences: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict:
        """Of the mean weighted cross-entropy; ``table``: the rows where a maximum was taken and their gradients."""
        gap = np.zeros(self.width - 1, sequences[0].dtype)
        parts = [np.concatenate([gap, s]) for s in sequences]
        starts = np.cumsum([0, *[len(p) for p in parts]])
        ids = np.concatenate([*parts, gap])
        pooled, where = self.maxima(ids, starts)
        grad = self.probabilities(pooled)
        grad[np.arange(len(parts)), labels] -= 1
        grad *= weights[:, None] / len(parts)
        down = grad @ self.dense.T
        seen = ids[where[..., None] + np.arange(self.width)]  # (batch, filters, width)
        inputs = self.table[seen].reshape(*where.shape, -1)
        back = (down[..., None] * self.conv.T[None]).reshape(-1, self.dim)
        touched, place = np.unique(seen.reshape(-1), return_inverse=True)
        summed = np.zeros((len(touched), self.dim), np.float32)
        np.add.at(summed, place, back)
        return {"dense": pooled.T @ grad, "out": grad.sum(0), "bias": down.sum(0), "conv": np.einsum("bf,bfk->kf", down, inputs) * self.mask, "table": (touched, summed)}

    def fit(self, sequences: list[np.ndarray], labels: np.ndarray, epochs: int, rate: float = 0.01, batch: int = 64, decay: float = 0.0, seed: int = 11, weights: np.ndarray | None = None) -> None:
        """Adam on cross-entropy; the table's rows are updated where a maximum was taken."""
        rng = np.random.default_rng(seed)
        weights = np.ones(len(sequences), np.float32) if weights is None else weights.astype(np.float32)
        self.begin()
        for epoch in range(epochs):
            order = rng.permutation(len(sequences))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                self.learn([sequences[i] for i in rows.tolist()], labels[rows], weights[rows], pace(rate, epoch, epochs), decay)
        self.end()

    def begin(self) -> None:
        """Adam's state, which ``learn`` reads and ``end`` drops."""
        self.first = {k: np.zeros_like(getattr(self, k)) for k in NAMES}
        self.second = {k: np.zeros_like(getattr(self, k)) for k in NAMES}
        self.step = 0

    def end(self) -> None:
        del self.first, self.second, self.step

    def learn(self, sequences: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, pace: float, decay: float) -> None:
        """One step."""
        first, second = self.first, self.second
        self.step += 1
        grads = self.gradients(sequences, labels, weights)
        touched, summed = grads.pop("table")
        fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            w = getattr(self, k)
            w -= pace * fix * first[k] / (np.sqrt(second[k]) + 1e-8) + pace * decay * w
        first["table"][touched] += 0.1 * (summed - first["table"][touched])
        second["table"][touched] += 0.001 * (summed**2 - second["table"][touched])
        self.table[touched] -= pace * fix * first["table"][touched] / (np.sqrt(second["table"][touched]) + 1e-8) + pace * decay * self.table[touched]
        self.table[0] = 0

    def state(self) -> np.ndarray:
        """Weights, Adam's state and steps in one vector, which ``put`` takes."""
        parts = [x for k in NAMES for x in (getattr(self, k), self.first[k], self.second[k])]
        return np.concatenate([x.reshape(-1) for x in parts] + [np.array([self.step], np.float32)])

    def put(self, state: np.ndarray) -> None:
        at = 0
        for k in NAMES:
            for x in (getattr(self, k), self.first[k], self.second[k]):
                x[...] = state[at : at + x.size].reshape(x.shape)
                at += x.size
        self.step = round(float(state[at]))


def pace(rate: float, epoch: int, epochs: int) -> float:
    """Step size of an epoch: a straight line down."""
    return rate * (1 - 0.9 * epoch / max(1, epochs))
