"""A bidirectional LSTM over sequences of block vectors with a logistic output for each block, in
numpy. Training is meant for a stated, bounded number of sequences; labelling runs inside tasks on
sequences of similar length and walks them in slices: the state is carried forward and backward from slice to
slice, and of each block only one number is kept between the two walks."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np

SLICE = 1024      # steps that are walked at a time


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiLSTM:
    def __init__(self, inputs: int, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w: dict[str, np.ndarray] = {}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))
            self.w[f"h{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.w[f"c{side}"] = np.zeros(4 * hidden)
            self.w[f"c{side}"][hidden:2 * hidden] = 1.0         # forget little at first
        self.w["o"] = rng.normal(0, 0.1, 2 * hidden)
        self.w["ox"] = rng.normal(0, 0.1, inputs)
        self.w["oc"] = np.zeros(1)

    def _walk(self, x: np.ndarray, live: np.ndarray, side: str, state: tuple[np.ndarray, np.ndarray], keep: list | None = None):
        """x: (time, batch, inputs), live: (time, batch, 1). Padding keeps the state. Returns the outputs and
        the state at the end; the steps' gates go to `keep`, if given."""
        d, (h, c) = self.hidden, state
        gates_in = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        out = np.zeros((*x.shape[:2], d))
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            z = gates_in[t] + h @ self.w[f"h{side}"]
            i, f, o = (_sigmoid(z[:, k * d:(k + 1) * d]) for k in range(3))
            g = np.tanh(z[:, 3 * d:])
            new = f * c + i * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, th, h))
            h = np.where(live[t], o * th, h)
            c = np.where(live[t], new, c)
            out[t] = h
        return out, (h, c)

    def _start(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((n, self.hidden)), np.zeros((n, self.hidden))

    def _logits(self, x: np.ndarray, live: np.ndarray):
        sides = {}
        for s in "fb":
            kept: list = []
            sides[s] = self._walk(x, live, s, self._start(x.shape[1]), kept)[0], kept
        both = np.concatenate([sides["f"][0], sides["b"][0]], -1)
        return both @ self.w["o"] + x @ self.w["ox"] + self.w["oc"][0], both, sides

    def label(self, part: Callable[[int, int], tuple[np.ndarray, np.ndarray]], steps: int, n: int) -> np.ndarray:
        """Probability of 1 for each (time, batch). `part(lo, hi)` gives the inputs (time, batch, ..) of those
        steps and the mask of what isn't padding; it is asked for each slice twice."""
        cuts, out, d = range(0, steps, SLICE), np.empty((steps, n)), self.hidden
        state = self._start(n)
        for lo in cuts:
            x, live = part(lo, min(lo + SLICE, steps))
            got, state = self._walk(x, live[..., None], "f", state)
            out[lo:lo + SLICE] = got @ self.w["o"][:d]
        state = self._start(n)
        for lo in reversed(cuts):
            x, live = part(lo, min(lo + SLICE, steps))
            got, state = self._walk(x, live[..., None], "b", state)
            out[lo:lo + SLICE] += got @ self.w["o"][d:] + x @ self.w["ox"] + self.w["oc"][0]
        return _sigmoid(out)

    def _gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        live3, d = live[..., None], self.hidden
        logit, both, sides = self._logits(x, live3)
        err = np.where(live, _sigmoid(logit) - y, 0) / max(1, live.sum())
        grad = {"o": np.einsum("tb,tbk->k", err, both), "ox": np.einsum("tb,tbk->k", err, x), "oc": np.array([err.sum()])}
        for n, side in enumerate("fb"):
            top = err[..., None] * self.w["o"][n * d:(n + 1) * d]
            wh = self.w[f"h{side}"]
            gx, gh, gc = np.zeros_like(self.w[f"x{side}"]), np.zeros_like(wh), np.zeros(4 * d)
            dh, dc = np.zeros((x.shape[1], d)), np.zeros((x.shape[1], d))
            for t, i, f, o, g, c, th, h in reversed(sides[side][1]):
                dh = dh + top[t]
                on = live3[t]
                do = dh * th * o * (1 - o)
                dnew = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do, dnew * i * (1 - g * g)], 1) * on
                gx += x[t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(0)
                dh = np.where(on, dz @ wh.T, dh)
                dc = np.where(on, dnew * f, dc)
            grad |= {f"x{side}": gx, f"h{side}": gh, f"c{side}": gc}
        return grad

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 30, batch: int = 32,
            rate: float = 0.02, seed: int = 11) -> BiLSTM:
        """sequences: (blocks by inputs, labels). Adam on mean logistic loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(sequences))
            for lo in range(0, len(order), batch):
                x, live, y = padded([sequences[i] for i in order[lo:lo + batch]])
                step += 1
                for k, g in self._gradients(x, live, y).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(time, batch, ..) arrays and the mask of what isn't padding."""
    most, n = max(len(x) for x, _ in sequences), len(sequences)
    x = np.zeros((most, n, sequences[0][0].shape[1]))
    live, y = np.zeros((most, n), bool), np.zeros((most, n))
    for j, (a, b) in enumerate(sequences):
        x[:len(a), j], live[:len(a), j], y[:len(a), j] = a, True, b
    return x, live, y
