"""A small gated recurrent network over token ids, in numpy, with a class-factored output layer.

Ids lie in classes of equal size, in order of frequency. The chance of the next id is that of its
class given the state, times that of the id among its class given the state.
"""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN = 16, 24
CLASSES = CLASS_SIZE = 48
IDS = CLASSES * CLASS_SIZE
# Steps that one truncated backpropagation, and one pass of scoring, goes through.
WINDOW = 32

SHAPES = {
    "embed": (IDS, EMBED), "wx": (EMBED, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
    "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wo": (IDS, HIDDEN), "bo": (IDS,),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters by name, as views into one vector."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray) -> np.ndarray:
    """Fixed starting parameters; the biases give the ids' frequencies, so an untrained model is a
    unigram model."""
    random = np.random.default_rng(7)
    flat = (random.standard_normal(SIZE) * 0.1).astype(np.float32)
    p = views(flat)
    share = np.log(counts + 0.5)
    p["b"][:] = 0
    p["bo"][:] = share
    by_class = share.reshape(CLASSES, CLASS_SIZE)
    top = by_class.max(axis=1)
    p["bc"][:] = top + np.log(np.exp(by_class - top[:, None]).sum(axis=1))
    p["bc"] -= p["bc"].max()
    p["wc"] *= 0.1
    p["wo"] *= 0.1
    return flat


def steps(p: dict[str, np.ndarray], ids: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """States after each step (steps x texts x HIDDEN), and what backpropagation needs, likewise:
    states before, both gates, the candidate and what the reset gate lets through of it."""
    kind, (n_steps, n_texts) = p["wh"].dtype, ids.shape
    # By gate first, so that each gate of a step is one run of memory. The logistic function of x is (1 + tanh(x / 2)) / 2.
    half = np.repeat(np.array([0.5, 0.5, 1], kind), HIDDEN)
    wh = np.ascontiguousarray((p["wh"] * half).reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
    if ids.size < IDS:
        table = p["embed"][ids.ravel()] @ (p["wx"] * half) + p["b"] * half
    else:
        table = (p["embed"] @ (p["wx"] * half) + p["b"] * half)[ids.ravel()]
    gates = np.ascontiguousarray(table.reshape(n_steps, n_texts, 3, HIDDEN).transpose(0, 2, 1, 3))
    states, from_h = np.empty((n_steps + 1, n_texts, HIDDEN), kind), np.empty_like(gates)
    states[0] = state
    some = np.empty((n_texts, HIDDEN), kind)
    for t in range(n_steps):
        h, now, own = states[t], gates[t], from_h[t]
        np.matmul(h, wh, out=own)
        rz, n = now[:2], now[2]
        rz += own[:2]
        np.tanh(rz, out=rz)
        rz += 1
        rz *= 0.5
        np.multiply(rz[0], own[2], out=some)
        n += some
        np.tanh(n, out=n)
        np.subtract(h, n, out=some)
        some *= rz[1]
        np.add(n, some, out=states[t + 1])
    return states[1:], (states[:-1], gates[:, 0], gates[:, 1], gates[:, 2], from_h[:, 2])


def _picked(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log softmax of each row of x at its target. Overwrites x."""
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(target)), target]
    np.exp(x, out=x)
    return own - np.log(x.sum(axis=1))


def _less_target(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The softmax of each row of x, less one at its target: the loss's gradient. Overwrites x."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    x[np.arange(len(target)), target] -= 1
    return x


class _Blocks:
    """Targets in blocks of ROWS of one class, so that the ids of all classes are worked out in a few calls.

    ``place`` is each target's row among the rows of all blocks, ``classes`` each block's class, and
    ``first`` the first block of each class that occurs.
    """

    ROWS = 16

    def __init__(self, target: np.ndarray):
        own = target // CLASS_SIZE
        n = np.bincount(own, minlength=CLASSES)
        many = -(-n // self.ROWS)
        self.seen = np.flatnonzero(n)
        self.classes = np.repeat(np.arange(CLASSES), many)
        before = np.cumsum(many) - many
        self.first = before[self.seen]
        order = np.argsort(own.astype(np.uint8), kind="stable")
        self.place = np.empty(len(target), np.int64)
        self.place[order] = np.arange(len(target)) + np.repeat(before * self.ROWS - (np.cumsum(n) - n), n)

    def dealt(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.classes) * self.ROWS, rows.shape[1]), rows.dtype)
        out[self.place] = rows
        return out.reshape(len(self.classes), self.ROWS, -1)


def log_chances(p: dict[str, np.ndarray], states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the chance of each target after its state."""
    out = _picked(states @ p["wc"] + p["bc"], target // CLASS_SIZE)
    blocks = _Blocks(target)
    wo, bo = p["wo"].reshape(CLASSES, CLASS_SIZE, HIDDEN)[blocks.classes], p["bo"].reshape(CLASSES, 1, CLASS_SIZE)[blocks.classes]
    among = blocks.dealt(states) @ wo.transpose(0, 2, 1)
    among += bo
    return out + _picked(among.reshape(-1, CLASS_SIZE)[blocks.place], target % CLASS_SIZE)


def gradient(flat: np.ndarray, ids: np.ndarray, target: np.ndarray, mask: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the mean loss over one window, state after it); the state before it is given."""
    p, grad = views(flat), np.zeros_like(flat)
    g = views(grad)
    states, kept = steps(p, ids, state)
    live = np.flatnonzero(mask.ravel())
    h, want = states.reshape(-1, HIDDEN)[live], target.ravel()[live]
    scale = np.float32(1 / max(1, len(live)))
    delta = _less_target(h @ p["wc"] + p["bc"], want // CLASS_SIZE)
    delta *= scale
    g["wc"][:], g["bc"][:] = h.T @ delta, delta.sum(axis=0)
    back_live = delta @ p["wc"].T
    blocks = _Blocks(want)
    by_class, wo = blocks.dealt(h), p["wo"].reshape(CLASSES, CLASS_SIZE, HIDDEN)[blocks.classes]
    among = by_class @ wo.transpose(0, 2, 1)
    among += p["bo"].reshape(CLASSES, 1, CLASS_SIZE)[blocks.classes]
    delta = _less_target(among.reshape(-1, CLASS_SIZE)[blocks.place], want % CLASS_SIZE)
    delta *= scale
    delta = blocks.dealt(delta)
    if len(live):
        g["wo"].reshape(CLASSES, CLASS_SIZE, HIDDEN)[blocks.seen] = np.add.reduceat(delta.transpose(0, 2, 1) @ by_class, blocks.first)
        g["bo"].reshape(CLASSES, CLASS_SIZE)[blocks.seen] = np.add.reduceat(delta.sum(axis=1), blocks.first)
    back_live += (delta @ wo).reshape(-1, HIDDEN)[blocks.place]
    back = np.zeros((mask.size, HIDDEN), flat.dtype)
    back[live] = back_live
    back = back.reshape(states.shape)
    before, r, z, n, inner = kept
    # What a step's loss passes on to the gates' inputs from the state, per unit that it passes to its state.
    passed = np.empty((len(ids), 3, *state.shape), flat.dtype)
    to_n = (1 - z) * (1 - n * n)
    np.multiply(to_n, r, out=passed[:, 2])
    np.multiply(passed[:, 2], inner * (1 - r), out=passed[:, 0])
    np.multiply(before - n, z * (1 - z), out=passed[:, 1])
    wh = np.ascontiguousarray(p["wh"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
    into, from_each = np.zeros_like(state, flat.dtype), np.empty((3, *state.shape), flat.dtype)
    for t in range(len(ids) - 1, -1, -1):
        now, own = back[t], passed[t]
        now += into
        own *= now
        np.matmul(own, wh, out=from_each)
        np.multiply(now, z[t], out=into)
        for each in from_each:
            into += each
    to_n *= back
    by_gate = before.reshape(-1, HIDDEN).T
    for k in range(3):
        g["wh"][:, k * HIDDEN : (k + 1) * HIDDEN] = by_gate @ passed[:, k].reshape(-1, HIDDEN)
    # The candidate's own input does not pass the reset gate.
    passed[:, 2] = to_n
    inputs = np.ascontiguousarray(passed.transpose(0, 2, 1, 3)).reshape(-1, 3 * HIDDEN)
    g["b"][:] = inputs.sum(axis=0)
    order = np.argsort(ids.ravel().astype(np.uint16), kind="stable")
    sorted_ids = ids.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    used = sorted_ids[first]
    summed = np.add.reduceat(inputs[order], first, axis=0)
    g["wx"][:] = p["embed"][used].T @ summed
    g["embed"][used] = summed @ p["wx"].T
    return grad, states[-1]


class Trainer:
    """Adagrad from given parameters."""

    def __init__(self, flat: np.ndarray, rate: float = 0.1):
        self.flat, self.squares, self.rate = flat.copy(), np.full_like(flat, 1e-4), rate

    def windows(self, ids: np.ndarray, target: np.ndarray, mask: np.ndarray) -> None:
        """Train on texts side by side (steps x texts), window by window; the state goes on."""
        state = np.zeros((ids.shape[1], HIDDEN), np.float32)
        for t in range(0, len(ids), WINDOW):
            part = slice(t, t + WINDOW)
            state = self.window(ids[part], target[part], mask[part], state)

    def window(self, ids: np.ndarray, target: np.ndarray, mask: np.ndarray, state: np.ndarray) -> np.ndarray:
        """One step of training; the state after the window."""
        grad, state = gradient(self.flat, ids, target, mask, state)
        size = np.sqrt(float(grad @ grad))
        grad *= min(1.0, 1.0 / max(size, 1e-9))
        self.squares += grad * grad
        self.flat -= self.rate * grad / np.sqrt(self.squares)
        return state


    def texts(self, tokens: np.ndarray, starts: np.ndarray, first: int, side: int, turn: int) -> None:
        """Train on every window of whole texts, given as for :func:`score`, the state carried on from
        a text's first to its last token. Texts of like length go side by side; ``turn`` orders the groups."""
        sizes = np.diff(starts)
        order = np.argsort(-sizes, kind="stable")
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[starts[:-1]] = first
        groups = range(0, len(order), side)
        for g in np.random.default_rng(turn).permutation(len(groups)):
            some = order[groups[g] : groups[g] + side]
            state = np.zeros((len(some), HIDDEN), np.float32)
            for t in range(0, int(sizes[some[0]]), WINDOW):
                live = int(np.searchsorted(-sizes[some], -t, side="left"))
                some, state = some[:live], state[:live]
                place = np.arange(t, t + min(WINDOW, int(sizes[some[0]]) - t))[:, None]
                inside = place < sizes[some]
                at = np.where(inside, starts[some] + place, 0)
                state = self.window(before[at], tokens[at], inside, state)


def score(flat: np.ndarray, tokens: np.ndarray, starts: np.ndarray, first: int, side: int = 1024) -> np.ndarray:
    """Natural log of the chance of each whole text; ``tokens`` of text i are starts[i] to
    starts[i + 1], all texts have at least one. Before a text comes the id ``first``.

    Texts of like length go side by side, window by window, and the state is carried on.
    """
    p, sizes = views(flat), np.diff(starts)
    out = np.zeros(len(sizes))
    order = np.argsort(-sizes, kind="stable")
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = first
    for lo in range(0, len(order), side):
        some = order[lo : lo + side]
        state = np.zeros((len(some), HIDDEN), np.float32)
        for t in range(0, int(sizes[some[0]]), WINDOW):
            # Sorted by length, so the texts that go on come first.
            live = int(np.searchsorted(-sizes[some], -t, side="left"))
            some, state = some[:live], state[:live]
            last = min(WINDOW, int(sizes[some[0]]) - t)
            place = np.arange(t, t + last)[:, None]
            inside = place < sizes[some]
            at = np.where(inside, starts[some] + place, 0)
            states, _ = steps(p, before[at], state)
            state = states[-1]
            flags = inside.ravel()
            chances = np.zeros(flags.size)
            chances[flags] = log_chances(p, states.reshape(-1, HIDDEN)[flags], tokens[at].ravel()[flags])
            out[some] += chances.reshape(inside.shape).sum(axis=0)
    return out
