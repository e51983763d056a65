"""A bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are windows of ``steps`` vectors; the output is one logit per window. ``forward`` keeps
what ``backward`` needs; ``score`` is the lean form used on the executors, where the input
projections of every distinct word are made once and windows only gather them.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(inputs: int, hidden: int, attention: int, rng: np.random.Generator) -> Params:
    def weights(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * np.sqrt(1 / shape[0])).astype(np.float32)

    p: Params = {}
    for d in "fb":
        p |= {f"x{d}": weights(inputs, 3 * hidden), f"h{d}": weights(hidden, 3 * hidden), f"c{d}": np.zeros(3 * hidden, np.float32)}
    p |= {"wa": weights(2 * hidden, attention), "ba": np.zeros(attention, np.float32), "va": weights(attention, 1)}
    return p | {"wo": weights(2 * hidden, 1), "bo": np.full(1, -1, np.float32)}


def _direction(p: Params, d: str, projected: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, rows, hidden) of one direction over the projected inputs (steps, rows, 3 hidden)."""
    steps, rows, hidden = projected.shape[0], projected.shape[1], p[f"h{d}"].shape[0]
    state, out, kept = np.zeros((rows, hidden), np.float32), np.empty((steps, rows, hidden), np.float32), [None] * steps
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        inner = state @ p[f"h{d}"]
        gates = sigmoid(projected[t, :, : 2 * hidden] + inner[:, : 2 * hidden])
        update, reset = gates[:, :hidden], gates[:, hidden:]
        fresh = np.tanh(projected[t, :, 2 * hidden :] + reset * inner[:, 2 * hidden :])
        kept[t] = (state, update, reset, fresh, inner[:, 2 * hidden :])
        state = fresh + update * (state - fresh)
        out[t] = state
    return out, kept


def _attend(p: Params, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen = np.tanh(states @ p["wa"] + p["ba"])
    weight = np.where(mask, (seen @ p["va"])[..., 0], -1e9)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    return seen, weight, (weight[..., None] * states).sum(axis=0)


def forward(p: Params, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """``x`` is (steps, rows, inputs), ``mask`` (steps, rows) is false where a window has no word."""
    (sf, kf), (sb, kb) = (_direction(p, d, x @ p[f"x{d}"] + p[f"c{d}"]) for d in "fb")
    states = np.concatenate((sf, sb), axis=2)
    seen, weight, pooled = _attend(p, states, mask)
    return (pooled @ p["wo"])[:, 0] + p["bo"][0], (x, kf, kb, states, seen, weight, pooled)


def backward(p: Params, kept: tuple, pull: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the parameters and of the inputs, for ``pull`` = d loss / d logit."""
    x, kf, kb, states, seen, weight, pooled = kept
    steps, hidden, g = x.shape[0], p["hf"].shape[0], {}
    g["wo"], g["bo"] = pooled.T @ pull[:, None], pull.sum(keepdims=True)
    to_pooled = pull[:, None] * p["wo"][:, 0]
    to_weight = (states * to_pooled).sum(axis=2)
    to_score = weight * (to_weight - (weight * to_weight).sum(axis=0))
    to_seen = to_score[..., None] * p["va"][:, 0] * (1 - seen**2)
    g["va"] = np.einsum("tra,tr->a", seen, to_score)[:, None]
    g["wa"], g["ba"] = np.einsum("trh,tra->ha", states, to_seen), to_seen.sum(axis=(0, 1))
    to_states = weight[..., None] * to_pooled + to_seen @ p["wa"].T
    to_x = np.zeros_like(x)
    for d, k, own in (("f", kf, to_states[..., :hidden]), ("b", kb, to_states[..., hidden:])):
        back, gh, to_projected = np.zeros_like(own[0]), np.zeros_like(p[f"h{d}"]), np.empty((*x.shape[:2], 3 * hidden), np.float32)
        for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
            state, update, reset, fresh, inner = k[t]
            back = back + own[t]
            to_fresh = back * (1 - update) * (1 - fresh**2)
            to_update = back * (state - fresh) * update * (1 - update)
            to_reset = to_fresh * inner * reset * (1 - reset)
            to_projected[t] = np.concatenate((to_update, to_reset, to_fresh), axis=1)
            to_inner = np.concatenate((to_update, to_reset, to_fresh * reset), axis=1)
            gh += state.T @ to_inner
            back = back * update + to_inner @ p[f"h{d}"].T
        g[f"h{d}"], g[f"c{d}"] = gh, to_projected.sum(axis=(0, 1))
        g[f"x{d}"] = np.einsum("tri,trh->ih", x, to_projected, optimize=True)
        to_x += to_projected @ p[f"x{d}"].T
    return g, to_x


def score(p: Params, projected: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of the windows whose steps are the rows ``at`` (steps, rows) of the projected inputs."""
    hidden = p["hf"].shape[0]
    steps, rows = at.shape
    states = np.empty((steps, rows, 2 * hidden), np.float32)
    for d, side in (("f", slice(0, hidden)), ("b", slice(hidden, 2 * hidden))):
        state, source, inward = np.zeros((rows, hidden), np.float32), projected[d], p[f"h{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            came, inner = source.take(at[t], axis=0), state @ inward
            gates = came[:, : 2 * hidden] + inner[:, : 2 * hidden]
            np.negative(gates, out=gates)
            np.exp(np.minimum(gates, 30, out=gates), out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            fresh = np.tanh(came[:, 2 * hidden :] + gates[:, hidden:] * inner[:, 2 * hidden :])
            state -= fresh
            state *= gates[:, :hidden]
            state += fresh
            states[t, :, side] = state
    return (_attend(p, states, mask)[2] @ p["wo"])[:, 0] + p["bo"][0]
