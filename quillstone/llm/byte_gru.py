"""A bidirectional gated recurrent network over bytes, in numpy, trained by backpropagation through time.

Both directions run side by side as one stacked array. The input of a step is a byte, so its share of the
gates is a row of a table; only the recurrent share is a product.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class ByteGru:
    """Labels every position of byte windows with class probabilities."""

    def __init__(self, classes: int, hidden: int = 12, seed: int = 0, dtype: type = np.float32):
        rng = np.random.Generator(np.random.PCG64(seed))
        h = self.hidden = hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * h)).astype(dtype),
            "h": rng.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)).astype(dtype),
            "o": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, classes)).astype(dtype),
            "b": np.zeros(classes, dtype),
        }

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(positions, windows, 2 * hidden) states for (windows, positions) bytes."""
        h, p = self.hidden, self.p
        n, t_max = x.shape
        s = np.zeros((2, n, h), p["h"].dtype)
        out = np.empty((t_max, n, 2 * h), p["h"].dtype)
        xt = np.ascontiguousarray(x.T)
        for t in range(t_max):
            gx = np.stack([p["x"][0][xt[t]], p["x"][1][xt[t_max - 1 - t]]])
            gh = s @ p["h"]
            zr = _sigmoid(gx[:, :, : 2 * h] + gh[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            c = np.tanh(gx[:, :, 2 * h :] + r * gh[:, :, 2 * h :])
            new = c + z * (s - c)
            if keep is not None:
                keep.append((s, z, r, c, gh[:, :, 2 * h :]))
            s = new
            out[t, :, :h] = s[0]
            out[t_max - 1 - t, :, h:] = s[1]
        return out

    def forward(self, x: np.ndarray) -> np.ndarray:
        """The same states without what training keeps: gates are halved beforehand so that a sigmoid is one tanh, and buffers are reused."""
        h, p = self.hidden, self.p
        n, t_max = x.shape
        half = p["h"].dtype.type(0.5)
        table, weight = p["x"].copy(), p["h"].copy()
        table[:, :, : 2 * h] *= half
        weight[:, :, : 2 * h] *= half
        s = np.zeros((2, n, h), weight.dtype)
        out = np.empty((t_max, n, 2 * h), weight.dtype)
        gx, gh = np.empty((2, n, 3 * h), weight.dtype), np.empty((2, n, 3 * h), weight.dtype)
        zr, c = np.empty((2, n, 2 * h), weight.dtype), np.empty((2, n, h), weight.dtype)
        xt = np.ascontiguousarray(x.T)
        for t in range(t_max):
            for k, at in ((0, t), (1, t_max - 1 - t)):
                np.take(table[k], xt[at], axis=0, out=gx[k], mode="clip")
                np.matmul(s[k], weight[k], out=gh[k])
            np.add(gx[:, :, : 2 * h], gh[:, :, : 2 * h], out=zr)
            np.tanh(zr, out=zr)
            zr *= half
            zr += half
            np.multiply(zr[:, :, h:], gh[:, :, 2 * h :], out=c)
            c += gx[:, :, 2 * h :]
            np.tanh(c, out=c)
            s -= c
            s *= zr[:, :, :h]
            s += c
            out[t, :, :h] = s[0]
            out[t_max - 1 - t, :, h:] = s[1]
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(classes, positions, windows)."""
        states = self.forward(x)
        a = self.p["o"].T @ states.reshape(-1, states.shape[2]).T + self.p["b"][:, None]
        a = np.exp(a - a.max(axis=0))
        return (a / a.sum(axis=0)).reshape(-1, *states.shape[:2])

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        a = np.exp(a - a.max(axis=-1, keepdims=True))
        return a / a.sum(axis=-1, keepdims=True)

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, each labelled with its window's class, and its gradients."""
        h, p = self.hidden, self.p
        n, t_max = x.shape
        keep: list = []
        states = self.states(x, keep)
        prob = self._softmax(states @ p["o"] + p["b"])
        rows = np.arange(n)
        loss = float(-np.log(prob[:, rows, y] + 1e-12).mean())
        d = prob
        d[:, rows, y] -= 1
        d /= n * t_max
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] = np.einsum("tnh,tnc->hc", states, d, optimize=True)
        g["b"] = d.sum(axis=(0, 1))
        ds = d @ p["o"].T
        carry = np.zeros((2, n, h), ds.dtype)
        back = p["h"].transpose(0, 2, 1)
        dgx = np.empty((2, t_max, n, 3 * h), ds.dtype)
        for t in range(t_max - 1, -1, -1):
            s, z, r, c, ghc = keep[t]
            carry = carry + np.stack([ds[t, :, :h], ds[t_max - 1 - t, :, h:]])
            dz = carry * (s - c) * z * (1 - z)
            dc = carry * (1 - z) * (1 - c * c)
            dr = dc * ghc * r * (1 - r)
            dgh = np.concatenate([dz, dr, dc * r], axis=2)
            dgx[0, t] = np.concatenate([dz[0], dr[0], dc[0]], axis=1)
            dgx[1, t_max - 1 - t] = np.concatenate([dz[1], dr[1], dc[1]], axis=1)
            g["h"] += s.transpose(0, 2, 1) @ dgh
            carry = carry * z + dgh @ back
        for k in range(2):
            np.add.at(g["x"][k], x.T.reshape(-1), dgx[k].reshape(-1, 3 * h))
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 220, batch: int = 128, rate: float = 0.02, seed: int = 1) -> float:
        """Adam over seeded batches; the mean loss of the last ten steps."""
        rng = np.random.Generator(np.random.PCG64(seed))
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, order, at = [], rng.permutation(len(x)), 0
        for step in range(1, steps + 1):
            if at + batch > len(order):
                order, at = rng.permutation(len(x)), 0
            rows = order[at : at + batch]
            at += batch
            loss, g = self.loss_and_gradients(x[rows], y[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            pace = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k in self.p:
                v = g[k] * scale
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                self.p[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(self.p[k].dtype)
        return float(np.mean(losses[-10:]))
