"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and decoding of batches of windows."""

from __future__ import annotations

import numpy as np

#: Character ids: 0 pads, 1 to 95 printable ASCII, then a line feed or tab, a letter beyond ASCII, anything else.
N_CHARS = 99


def char_ids(text: str) -> np.ndarray:
    """An id for each code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.full(len(c), 98, np.int16)
    ascii_ = (c >= 32) & (c <= 126)
    out[ascii_] = c[ascii_] - 31
    out[(c >= 9) & (c <= 13)] = 96
    out[c >= 0xAA] = 97
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logsumexp(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class Tagger:
    """Scores each character's tags from both directions; a linear chain over tags picks the best sequence."""

    def __init__(self, tags: int, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.h, self.k = hidden, tags
        g = lambda *s, scale=0.1: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": g(N_CHARS, 4 * hidden, scale=0.3), f"h{d}": g(hidden, 4 * hidden, scale=0.2), f"b{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1.0  # remember by default
        self.p |= {"out": g(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "trans": g(tags, tags)}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction; x is (T, B). keep: also what the backward pass needs."""
        t, b, h = x.shape[0], x.shape[1], self.h
        wh, bias, wx = self.p[f"h{d}"], self.p[f"b{d}"], self.p[f"x{d}"]
        hs, c, last = np.empty((t, b, h), np.float32), np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        saved = []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[x[i]] + last @ wh
            z += bias
            s = _sigmoid(z[:, : 3 * h])
            u = np.tanh(z[:, 3 * h :])
            before, c = c, s[:, h : 2 * h] * c + s[:, :h] * u
            tc = np.tanh(c)
            if keep:
                saved.append((i, s, u, before, tc, last))
            last = s[:, 2 * h :] * tc
            hs[i] = last
        return hs, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        hidden = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=2)
        return hidden @ self.p["out"] + self.p["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (T, B) by the Viterbi recursion."""
        e, trans = self.emissions(x), self.p["trans"]
        t, b, _ = e.shape
        back = np.empty((t, b, self.k), np.int8)
        score = e[0]
        for i in range(1, t):
            s = score[:, :, None] + trans[None]
            back[i] = s.argmax(axis=1)
            score = s.max(axis=1) + e[i]
        out = np.empty((t, b), np.int8)
        out[-1] = score.argmax(axis=1)
        for i in range(t - 1, 0, -1):
            out[i - 1] = back[i][np.arange(b), out[i]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood per character and its gradients, by forward-backward and back-propagation."""
        t, b = x.shape
        hf, sf = self._run(x, "f", True)
        hb, sb = self._run(x, "b", True)
        hidden = np.concatenate([hf, hb], axis=2)
        e, trans = (hidden @ self.p["out"] + self.p["bias"]).astype(np.float64), self.p["trans"].astype(np.float64)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for i in range(1, t):
            alpha[i] = _logsumexp(alpha[i - 1][:, :, None] + trans[None], 1) + e[i]
        for i in range(t - 2, -1, -1):
            beta[i] = _logsumexp(trans[None] + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        rows = np.arange(b)
        gold = sum(e[i, rows, y[i]] for i in range(t)) + sum(trans[y[i - 1], y[i]] for i in range(1, t))
        de = np.exp(alpha + beta - z[None, :, None])
        dtrans = np.zeros_like(trans)
        for i in range(1, t):
            dtrans += np.exp(alpha[i - 1][:, :, None] + trans[None] + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(dtrans, (y[i - 1], y[i]), -1)
        np.add.at(de, (np.arange(t)[:, None], rows[None, :], y), -1)
        n = t * b
        de = (de / n).astype(np.float32)
        g = {"trans": (dtrans / n).astype(np.float32), "bias": de.sum(axis=(0, 1)), "out": hidden.reshape(n, -1).T @ de.reshape(n, -1)}
        dh = de @ self.p["out"].T
        for d, saved, part in (("f", sf, dh[:, :, : self.h]), ("b", sb, dh[:, :, self.h :])):
            g |= self._back(x, d, saved, part)
        return float((z - gold).sum() / n), g

    def _back(self, x, d, saved, dh):
        h = self.h
        wh = self.p[f"h{d}"]
        gx, gh, gb = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh), np.zeros_like(self.p[f"b{d}"])
        next_h, next_c = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        for i, s, u, before, tc, last in reversed(saved):
            own = dh[i] + next_h
            dc = own * s[:, 2 * h :] * (1 - tc * tc) + next_c
            gates = np.concatenate([dc * u, dc * before, own * tc], axis=1) * s * (1 - s)
            dz = np.concatenate([gates, dc * s[:, :h] * (1 - u * u)], axis=1)
            np.add.at(gx, x[i], dz)
            gh += last.T @ dz
            gb += dz.sum(axis=0)
            next_h, next_c = dz @ wh.T, dc * s[:, h : 2 * h]
        return {f"x{d}": gx, f"h{d}": gh, f"b{d}": gb}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam on random batches of windows; x and y are (windows, T). Returns the losses."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, g = self.gradients(x[pick].T, y[pick].T)
            losses.append(loss)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
        return losses
