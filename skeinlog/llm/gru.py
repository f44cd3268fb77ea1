"""A bidirectional gated recurrent layer with attention pooling, forward and backward, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class BiGRU:
    """Sequences of vectors to one vector each. The two directions are the first axis of every weight.

    There is no mask: sequences are padded with a symbol of their own, which the layer learns like any other.
    """

    def __init__(self, inputs: int, hidden: int, attend: int, rng: np.random.Generator | None = None) -> None:
        self.h = hidden
        if rng is not None:
            draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
            self.p = {"wx": draw(2, inputs, 3 * hidden), "wh": draw(2, hidden, 3 * hidden), "b": np.zeros((2, 1, 3 * hidden), np.float32), "wa": draw(2 * hidden, attend), "va": draw(attend, 1)}

    def project(self, x: np.ndarray) -> np.ndarray:
        """Each vector's part in the gates: (n, inputs) to (2, n, 3h)."""
        return np.matmul(x[None], self.p["wx"]) + self.p["b"]

    def run(self, gates: np.ndarray, keep: bool = False):
        """gates: (T, 2, B, 3h), the second direction's already reversed in time. (B, 2h), and what backward needs if keep."""
        steps, _, n, _ = gates.shape
        h = self.h
        state = np.zeros((2, n, h), np.float32)
        every = np.empty((steps, 2, n, h), np.float32)
        kept = []
        for t in range(steps):
            g = np.matmul(state, self.p["wh"])
            zr = _sigmoid(gates[t, :, :, : 2 * h] + g[:, :, : 2 * h])
            z, r = zr[:, :, :h], zr[:, :, h:]
            new = np.tanh(gates[t, :, :, 2 * h :] + r * g[:, :, 2 * h :])
            if keep:
                kept.append((state, z, r, new, g[:, :, 2 * h :]))
            state = new + z * (state - new)
            every[t] = state
        both = np.concatenate((every[:, 0], every[::-1, 1]), axis=2)  # (T, B, 2h) in the order of time
        u = np.tanh(both @ self.p["wa"])
        a = (u @ self.p["va"])[:, :, 0]
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        out = np.einsum("tb,tbh->bh", a, both)
        return (out, (gates, kept, both, u, a, out)) if keep else out

    def back(self, d: np.ndarray, cache, grads: dict) -> np.ndarray:
        """Adds this layer's gradients to grads; the gradient of gates."""
        gates, kept, both, u, a, out = cache
        h = self.h
        dboth = a[:, :, None] * d[None]
        ds = a * (np.einsum("tbh,bh->tb", both, d) - np.einsum("bh,bh->b", out, d)[None])
        grads["va"] += np.einsum("tba,tb->a", u, ds)[:, None]
        du = ds[:, :, None] * self.p["va"][:, 0] * (1 - u * u)
        grads["wa"] += np.einsum("tbh,tba->ha", both, du)
        dboth += du @ self.p["wa"].T
        dh = np.stack((dboth[:, :, :h], dboth[::-1, :, h:]), axis=1)
        dgates = np.empty_like(gates)
        carry = np.zeros_like(dh[0])
        wh_t = self.p["wh"].transpose(0, 2, 1)
        for t in range(len(gates) - 1, -1, -1):
            state, z, r, new, gn = kept[t]
            d_out = dh[t] + carry
            dnew = d_out * (1 - z) * (1 - new * new)
            dz = d_out * (state - new) * z * (1 - z)
            dr = dnew * gn * r * (1 - r)
            dg = np.concatenate((dz, dr, dnew * r), axis=2)
            dgates[t] = np.concatenate((dz, dr, dnew), axis=2)
            grads["wh"] += np.matmul(state.transpose(0, 2, 1), dg)
            carry = d_out * z + np.matmul(dg, wh_t)
        return dgates
