"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Arrays are ``(time, batch, width)``.  Training is by Adam on the negative
log-likelihood of the CRF; decoding is Viterbi.
"""

from __future__ import annotations

import numpy as np

FORWARD, BACKWARD = 0, 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Tags the symbols of equally long windows."""

    def __init__(self, symbols: int, tags: int, embedding: int = 12, hidden: int = 16, seed: int = 5, dtype=np.float32):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(dtype)
        self.hidden = hidden
        self.params = {"embed": (rng.normal(0, 0.5, (symbols, embedding))).astype(dtype), "out": normal(2 * hidden, tags), "out_b": np.zeros(tags, dtype), "move": np.zeros((tags, tags), dtype)}
        for d in (FORWARD, BACKWARD):
            bias = np.zeros(4 * hidden, dtype)
            bias[hidden : 2 * hidden] = 1
            self.params |= {f"x{d}": normal(embedding, 4 * hidden), f"h{d}": normal(hidden, 4 * hidden), f"b{d}": bias}

    def _lstm(self, x: np.ndarray, d: int, keep: bool) -> tuple[np.ndarray, list]:
        p, n = self.params, self.hidden
        steps, batch, _ = x.shape
        into = (x.reshape(-1, x.shape[2]) @ p[f"x{d}"] + p[f"b{d}"]).reshape(steps, batch, -1)
        h, c = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype)
        out, held = np.empty((steps, batch, n), x.dtype), []
        for t in range(steps) if d == FORWARD else range(steps - 1, -1, -1):
            z = into[t] + h @ p[f"h{d}"]
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before = c
            c = gates[:, n : 2 * n] * c + gates[:, :n] * g
            th = np.tanh(c)
            if keep:
                held.append((t, gates, g, before, th, h))
            h = gates[:, 2 * n :] * th
            out[t] = h
        return out, held

    def _lstm_back(self, x: np.ndarray, d: int, held: list, dout: np.ndarray, grads: dict) -> np.ndarray:
        p, n = self.params, self.hidden
        dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        dinto = np.empty((*x.shape[:2], 4 * n), x.dtype)
        grads[f"h{d}"] = np.zeros_like(p[f"h{d}"])
        for t, gates, g, before, th, h in reversed(held):
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - th * th)
            dz = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dinto[t] = dz
            grads[f"h{d}"] += h.T @ dz
            dh, dc = dz @ p[f"h{d}"].T, dc * f
        flat = dinto.reshape(-1, 4 * n)
        grads[f"x{d}"], grads[f"b{d}"] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(axis=0)
        return (flat @ p[f"x{d}"].T).reshape(x.shape)

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """The score of each tag at each place; ``symbols`` is ``(time, batch)``."""
        x = self.params["embed"][symbols]
        both = np.concatenate([self._lstm(x, d, False)[0] for d in (FORWARD, BACKWARD)], axis=2)
        return both @ self.params["out"] + self.params["out_b"]

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """The best path of tags for each window, by Viterbi."""
        score = self.emissions(symbols)
        move, steps = self.params["move"], len(score)
        best, back = score[0], np.empty(score.shape, np.int8)
        for t in range(1, steps):
            through = best[:, :, None] + move
            back[t] = through.argmax(axis=1)
            best = through.max(axis=1) + score[t]
        path = np.empty(score.shape[:2], np.int8)
        path[-1] = best.argmax(axis=1)
        rows = np.arange(score.shape[1])
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        return path

    def loss(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        p = self.params
        x = p["embed"][symbols]
        runs = [self._lstm(x, d, True) for d in (FORWARD, BACKWARD)]
        both = np.concatenate([out for out, _ in runs], axis=2)
        score = (both @ p["out"] + p["out_b"]).astype(np.float64)
        move = p["move"].astype(np.float64)
        value, dscore, dmove = crf_loss(score, move, tags)
        dscore = dscore.astype(x.dtype)
        flat = dscore.reshape(-1, dscore.shape[2])
        grads = {"out": both.reshape(-1, both.shape[2]).T @ flat, "out_b": flat.sum(axis=0), "move": dmove.astype(x.dtype)}
        dboth = dscore @ p["out"].T
        dx = sum(self._lstm_back(x, d, runs[d][1], dboth[:, :, d * self.hidden : (d + 1) * self.hidden], grads) for d in (FORWARD, BACKWARD))
        grads["embed"] = np.zeros_like(p["embed"])
        np.add.at(grads["embed"], symbols, dx)
        return value, grads


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def crf_loss(score: np.ndarray, move: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the paths, with gradients for the scores and the transitions."""
    steps, batch, n = score.shape
    ahead, after = np.empty_like(score), np.zeros_like(score)
    ahead[0] = score[0]
    for t in range(1, steps):
        ahead[t] = _log_sum(ahead[t - 1][:, :, None] + move, 1) + score[t]
    for t in range(steps - 2, -1, -1):
        after[t] = _log_sum(move + (after[t + 1] + score[t + 1])[:, None, :], 2)
    total = _log_sum(ahead[-1], 1)
    rows = np.arange(batch)
    value = total.sum()
    dscore = np.exp(ahead + after - total[None, :, None])
    dmove = np.zeros_like(move)
    for t in range(steps):
        value -= score[t, rows, tags[t]].sum()
        dscore[t, rows, tags[t]] -= 1
        if t:
            pair = ahead[t - 1][:, :, None] + move + (score[t] + after[t])[:, None, :] - total[:, None, None]
            dmove += np.exp(pair).sum(axis=0)
            np.add.at(dmove, (tags[t - 1], tags[t]), -1)
            value -= move[tags[t - 1], tags[t]].sum()
    return float(value / batch), dscore / batch, dmove / batch


def train(tagger: Tagger, batches, rate: float = 0.06) -> Tagger:
    """Fit by Adam on ``(symbols, tags)`` batches; the rate falls to a tenth."""
    batches = list(batches)
    held = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in tagger.params.items()}
    for step, (symbols, tags) in enumerate(batches, 1):
        _, grads = tagger.loss(symbols, tags)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * 0.1 ** (step / len(batches))
        for k, g in grads.items():
            g = g * min(1.0, 20.0 / max(norm, 1e-9))
            m, v = held[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            tagger.params[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return tagger
