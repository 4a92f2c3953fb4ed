"""A bidirectional gated recurrent network over bytes, in numpy: training by backpropagation through time, inference."""

from __future__ import annotations

import numpy as np

#: Byte value that pads a window; its positions carry no label and no probability.
PAD = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGRU:
    """Labels every byte of a window with one of `labels` classes; both directions see the whole window.

    Per direction: table (256, 3H) of input contributions, recurrent (H, 3H), bias (3H,); gates in order z, r, n.
    """

    def __init__(self, labels: int, hidden: int = 16, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.hidden, self.labels = hidden, labels
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"out": f(2 * hidden, labels, scale=hidden**-0.5), "out_b": np.zeros(labels, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(256, 3 * hidden, scale=0.4), f"u{d}": f(hidden, 3 * hidden, scale=hidden**-0.5), f"c{d}": np.zeros(3 * hidden, np.float32)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    # ------------------------------------------------------------ training

    def _forward(self, x: np.ndarray, d: str) -> list[tuple]:
        """x (T, B) in reading order of the direction; per step (h before, z, r, n, h @ u_n, h after)."""
        H = self.hidden
        inputs = self.p[f"x{d}"][x] + self.p[f"c{d}"]
        u = self.p[f"u{d}"]
        h = np.zeros((x.shape[1], H), np.float32)
        kept = []
        for a in inputs:
            m = h @ u
            zr = _sigmoid(a[:, : 2 * H] + m[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(a[:, 2 * H :] + r * m[:, 2 * H :])
            new = n + z * (h - n)
            kept.append((h, z, r, n, m[:, 2 * H :], new))
            h = new
        return kept

    def _backward(self, x: np.ndarray, d: str, kept: list[tuple], grad_h: np.ndarray) -> dict[str, np.ndarray]:
        H = self.hidden
        u = self.p[f"u{d}"]
        back = np.zeros_like(kept[0][0])
        ga = np.empty((*x.shape, 3 * H), np.float32)
        gu = np.zeros_like(u)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, mn, _ = kept[t]
            g = grad_h[t] + back
            gn = g * (1 - z) * (1 - n * n)
            gz = g * (h - n) * z * (1 - z)
            gr = gn * mn * r * (1 - r)
            ga[t, :, :H], ga[t, :, H : 2 * H], ga[t, :, 2 * H :] = gz, gr, gn
            gm = np.concatenate([gz, gr, gn * r], axis=1)
            gu += h.T @ gm
            back = g * z + gm @ u.T
        flat, codes = ga.reshape(-1, 3 * H), x.reshape(-1)
        order = np.argsort(codes, kind="stable")
        values, first = np.unique(codes[order], return_index=True)
        gx = np.zeros_like(self.p[f"x{d}"])
        gx[values] = np.add.reduceat(flat[order], first, axis=0)
        return {f"x{d}": gx, f"u{d}": gu, f"c{d}": flat.sum(axis=0)}

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One Adam step on windows x (B, T) uint8 with one label y (B,) each, held at every position; the loss."""
        xt = x.T.astype(np.int64)
        T, B = xt.shape
        fwd, bwd = self._forward(xt, "f"), self._forward(xt[::-1], "b")
        hf, hb = np.stack([k[5] for k in fwd]), np.stack([k[5] for k in bwd])[::-1]
        both = np.concatenate([hf, hb], axis=2)
        logits = both @ self.p["out"] + self.p["out_b"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        prob = e / e.sum(axis=2, keepdims=True)
        mask = (xt != PAD).astype(np.float32)
        count = max(mask.sum(), 1)
        loss = float(-(np.log(np.take_along_axis(prob, np.broadcast_to(y, (T, B))[..., None], 2)[..., 0] + 1e-9) * mask).sum() / count)
        g = prob
        g[:, np.arange(B), y] -= 1
        g *= mask[..., None] / count
        grads = {"out": both.reshape(T * B, -1).T @ g.reshape(T * B, -1), "out_b": g.sum(axis=(0, 1))}
        gh = g @ self.p["out"].T
        H = self.hidden
        grads |= self._backward(xt, "f", fwd, gh[..., :H])
        grads |= self._backward(xt[::-1], "b", bwd, gh[..., H:][::-1])
        norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        self.steps += 1
        for k, v in grads.items():
            m, s = self.moments[k]
            v = v * scale
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            self.p[k] -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32)
        return loss

    # ------------------------------------------------------------ inference

    def state(self) -> dict[str, np.ndarray]:
        return self.p

    @staticmethod
    def of(state: dict[str, np.ndarray]) -> ByteGRU:
        g = ByteGRU.__new__(ByteGRU)
        g.p, g.hidden, g.labels = state, state["uf"].shape[0], state["out"].shape[1]
        return g

    def _walk(self, x: np.ndarray, d: str) -> np.ndarray:
        """Logit contributions (T, labels, B) of one direction, x (T, B) in its reading order.

        Features lie in rows, so that each gate is one contiguous block. Gates use tanh of half the sum; the halves are
        folded into the weights: z and r are kept as twice their values, and the candidate's weights as a half.
        """
        H = self.hidden
        table = (self.p[f"x{d}"] + self.p[f"c{d}"]).T.copy()
        u = self.p[f"u{d}"].T * np.float32(0.5)
        table[: 2 * H] *= 0.5
        out = np.ascontiguousarray((self.p["out"][:H] if d == "f" else self.p["out"][H:]).T)
        B = x.shape[1]
        h, n = np.zeros((H, B), np.float32), np.empty((H, B), np.float32)
        a, m = np.empty((3 * H, B), np.float32), np.empty((3 * H, B), np.float32)
        gates, candidate = a[: 2 * H], m[2 * H :]
        made = np.empty((len(x), self.labels, B), np.float32)
        for t in range(len(x)):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=m)
            gates += m[: 2 * H]
            np.tanh(gates, out=gates)
            gates += 1
            candidate *= gates[H:]
            candidate += a[2 * H :]
            np.tanh(candidate, out=n)
            h -= n
            h *= gates[:H]
            h *= 0.5
            h += n
            np.matmul(out, h, out=made[t])
        return made

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities (T, labels, B) of every position of windows x (B, T) uint8."""
        xt = np.ascontiguousarray(x.T, np.intp)
        logits = self._walk(xt, "f")
        logits += self._walk(xt[::-1], "b")[::-1]
        logits += self.p["out_b"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(B, labels): probabilities summed over the positions of each window that aren't padding."""
        p = self.positions(x)
        p *= (x.T != PAD)[:, None, :]
        return p.sum(axis=0).T
