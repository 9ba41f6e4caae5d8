"""A bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class AttentiveBiGRU:
    """Windows of word vectors (batch, time, width) to one logit each.

    Gates lie in the order reset, update, new; both directions are concatenated, and a small
    attention network weighs the words of a window.
    """

    def __init__(self, width: int, hidden: int = 6, attention: int = 6, seed: int = 7, dtype=np.float32):
        rng = np.random.default_rng(seed)

        def weights(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(dtype)

        self.hidden = hidden
        self.p = {"wa": weights(2 * hidden, attention), "ba": np.zeros(attention, dtype), "va": weights(attention), "wo": weights(2 * hidden), "bo": np.zeros(1, dtype)}
        for d in "fb":
            self.p |= {f"x{d}": weights(width, 3 * hidden), f"u{d}": weights(hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, dtype)}

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """The inputs' part of all gates; once a word, however many windows hold it."""
        return {d: x @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def _run(self, inputs, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (time, batch, hidden); ``inputs(t)`` are the projected inputs of time t."""
        batch, steps = mask.shape
        h, n = np.zeros((batch, self.hidden), self.p["wo"].dtype), self.hidden
        out = np.empty((steps, batch, n), h.dtype)
        full = mask.all(axis=0)
        for t in range(steps) if d == "f" else reversed(range(steps)):
            a, u = inputs(t), h @ self.p[f"u{d}"]
            g = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
            r, z = g[:, :n], g[:, n:]
            new = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
            nxt = new + z * (h - new)
            if not full[t]:
                nxt = np.where(mask[:, t, None], nxt, h)
            if keep is not None:
                keep.append((t, h, r, z, new, u[:, 2 * n :]))
            out[t] = h = nxt
        return out

    def logits(self, inputs: dict, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        kept = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self._run(inputs[d], mask, d, kept[d]) for d in "fb"], axis=2)
        act = np.tanh(states @ self.p["wa"] + self.p["ba"])
        score = np.where(mask.T, act @ self.p["va"], -1e9)
        score = np.exp(score - score.max(axis=0))
        weight = score / score.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep |= {"kept": kept, "states": states, "act": act, "weight": weight, "pooled": pooled}
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        projected = self.project(x)
        return self.logits({d: (lambda t, a=projected[d]: a[:, t]) for d in "fb"}, mask, keep)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted logistic loss and its gradients, under ``x`` that of the inputs."""
        k: dict = {}
        logit = self.forward(x, mask, k)
        prob = _sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / weight.sum())
        dl = (weight * (prob - y) / weight.sum()).astype(x.dtype)
        g = {"wo": k["pooled"].T @ dl, "bo": np.array([dl.sum()], x.dtype)}
        dpool = dl[:, None] * self.p["wo"]
        states, act, att = k["states"], k["act"], k["weight"]
        dstates = att[:, :, None] * dpool
        datt = (states * dpool).sum(axis=2)
        dscore = att * (datt - (att * datt).sum(axis=0))
        g["va"] = (act * dscore[:, :, None]).sum(axis=(0, 1))
        dact = dscore[:, :, None] * self.p["va"] * (1 - act**2)
        g["wa"], g["ba"] = np.einsum("tbi,tbj->ij", states, dact), dact.sum(axis=(0, 1))
        dstates = dstates + dact @ self.p["wa"].T
        n = self.hidden
        g["x"] = np.zeros_like(x)
        for d, part in (("f", dstates[:, :, :n]), ("b", dstates[:, :, n:])):
            u = self.p[f"u{d}"]
            g |= {f"x{d}": np.zeros_like(self.p[f"x{d}"]), f"u{d}": np.zeros_like(u), f"c{d}": np.zeros_like(self.p[f"c{d}"])}
            dh = np.zeros_like(part[0])
            for t, h, r, z, new, un in reversed(k["kept"][d]):
                dh = dh + part[t]
                m = mask[:, t, None]
                dnext, through = np.where(m, dh, 0), np.where(m, 0, dh)
                dnew = dnext * (1 - z) * (1 - new**2)
                dz = dnext * (h - new) * z * (1 - z)
                dr = dnew * un * r * (1 - r)
                dgates = np.concatenate((dr, dz, dnew), axis=1)
                drec = np.concatenate((dr, dz, dnew * r), axis=1)
                g[f"x{d}"] += x[:, t].T @ dgates
                g[f"c{d}"] += dgates.sum(axis=0)
                g["x"][:, t] += dgates @ self.p[f"x{d}"].T
                g[f"u{d}"] += h.T @ drec
                dh = through + dnext * z + drec @ u.T
        return loss, g

    def train(self, inputs, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 11) -> float:
        """Adam; returns the last epoch's mean loss.

        ``inputs`` makes the word vectors of chosen windows (``of``), takes their gradients apart for its own
        parameters ``p`` (``back``), and learns along.
        """
        rng = np.random.default_rng(seed)
        parts = [(self.p, 1e-4), (inputs.p, inputs.decay)]
        moments = [{k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()} for p, _ in parts]
        step, loss = 0, 0.0
        for epoch in range(epochs):
            order, losses = rng.permutation(len(y)), []
            for a in range(0, len(order), batch):
                i = order[a : a + batch]
                value, g = self.gradients(inputs.of(i), mask[i], y[i], weight[i])
                g |= inputs.back(i, g.pop("x"))
                losses.append(value)
                step += 1
                speed = rate * (1 - epoch / (epochs + 1))
                for (p, decay), moment in zip(parts, moments, strict=True):
                    for name in p:
                        grad = g[name] + decay * p[name]
                        first, second = moment[name]
                        first += 0.1 * (grad - first)
                        second += 0.01 * (grad**2 - second)
                        p[name] -= (speed * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(p[name].dtype)
            loss = float(np.mean(losses))
        return loss
