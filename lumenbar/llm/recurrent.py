"""A gated recurrent language model with class-factored output, in numpy.

The output is a softmax over classes and, inside a class of frequent words, a softmax over
its words. Classes of rare words share their probability by corpus counts instead, so the
model spans a vocabulary of any size with a bounded number of weights. Training truncates
backpropagation at the end of a window and carries the state on; scoring carries the state
over windows through the whole document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Layout:
    """Symbols 0..heads-1 are frequent words, ordered by class; then one symbol for each
    class of rare words; then the start symbol.

    ``edges[g]:edges[g + 1]`` are the words of class g; classes from ``len(edges) - 1`` on
    are those of rare words.
    """

    edges: np.ndarray
    tails: int

    @property
    def heads(self) -> int:
        return int(self.edges[-1])

    @property
    def head_classes(self) -> int:
        return len(self.edges) - 1

    @property
    def classes(self) -> int:
        return self.head_classes + self.tails

    @property
    def start(self) -> int:
        return self.heads + self.tails

    def class_of(self) -> np.ndarray:
        heads = np.repeat(np.arange(self.head_classes), np.diff(self.edges))
        return np.concatenate([heads, np.arange(self.head_classes, self.classes)])


@dataclass
class Weights:
    inputs: np.ndarray  # symbol -> update, reset and candidate gate inputs
    recurrent: np.ndarray  # state -> the same
    to_class: np.ndarray
    class_bias: np.ndarray
    to_word: np.ndarray
    word_bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [
            self.inputs, self.recurrent, self.to_class, self.class_bias, self.to_word, self.word_bias
        ]


def initial(layout: Layout, hidden: int, mass: np.ndarray, seed: int) -> Weights:
    """Starts as the unigram model: biases are log shares. ``mass``: counts by symbol."""
    rng = np.random.default_rng(seed)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.normal(size=shape) * scale).astype(np.float32)

    by_class = np.bincount(layout.class_of(), mass, minlength=layout.classes)
    return Weights(
        draw(layout.start + 1, 3 * hidden, scale=0.1),
        draw(hidden, 3 * hidden, scale=hidden**-0.5),
        draw(hidden, layout.classes, scale=0.01),
        np.log(np.maximum(by_class, 1e-3) / by_class.sum()).astype(np.float32),
        draw(hidden, layout.heads, scale=0.01),
        np.log(np.maximum(mass[: layout.heads], 1e-3)).astype(np.float32),
    )


def step(w: Weights, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """State after reading the symbols ``x``, one a lane; what the way back needs."""
    return _moved(w, h, w.inputs[x])


def _moved(w: Weights, h: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, tuple]:
    """State after the gate inputs ``a``, which are overwritten; what the way back needs."""
    n = h.shape[1]
    u = h @ w.recurrent
    gates, c, un = a[:, : 2 * n], a[:, 2 * n :], u[:, 2 * n :]
    gates += u[:, : 2 * n]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    z, r = gates[:, :n], gates[:, n:]
    c += r * un
    np.tanh(c, out=c)
    after = h - c
    after *= z
    after += c
    return after, (h, z, r, un, c)


def _softmax(x: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Turns ``x`` into probabilities in place; the log probability of each row's goal."""
    rows = np.arange(len(x))
    x -= x.max(axis=1, keepdims=True)
    at_goal = x[rows, goal]
    np.exp(x, out=x)
    total = x.sum(axis=1, keepdims=True)
    x /= total
    return at_goal - np.log(total[:, 0])


def _goal_log_softmax(x: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Log probability of each row's goal; ``x`` is overwritten."""
    x -= x.max(axis=1, keepdims=True)
    at_goal = x[np.arange(len(x)), goal]
    np.exp(x, out=x)
    return at_goal - np.log(x.sum(axis=1))


def by_class(layout: Layout, class_of: np.ndarray, y: np.ndarray):
    """Positions in ``y`` ordered by class, and for each head class among the targets:
    (class, first and last place in that order)."""
    classes = class_of[y].astype(np.int16 if layout.classes < 2**15 else np.int64)
    order = np.argsort(classes, kind="stable")
    cut = np.searchsorted(classes[order], np.arange(layout.head_classes + 1)).tolist()
    found = ((g, cut[g], cut[g + 1]) for g in range(layout.head_classes))
    return order, [x for x in found if x[1] < x[2]]


def log_probabilities(
    w: Weights, layout: Layout, class_of: np.ndarray, h: np.ndarray, y: np.ndarray
) -> np.ndarray:
    """Natural log probability of each target symbol (a rare word's class) given states."""
    logit = h @ w.to_class
    logit += w.class_bias
    out = _goal_log_softmax(logit, class_of[y]).astype(np.float64)
    order, classes = by_class(layout, class_of, y)
    states, goals = h[order], y[order]
    for g, start, end in classes:
        lo, hi = layout.edges[g], layout.edges[g + 1]
        inside = states[start:end] @ w.to_word[:, lo:hi]
        inside += w.word_bias[lo:hi]
        out[order[start:end]] += _goal_log_softmax(inside, goals[start:end] - lo)
    return out


def _window_gradient(
    w: Weights, layout: Layout, class_of: np.ndarray, h: np.ndarray, x: np.ndarray, y: np.ndarray
) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Gradients of the mean loss over a window (steps, lanes), the last state, the loss."""
    steps, lanes = x.shape
    n = h.shape[1]
    kept = (x != layout.start).astype(np.float32)[:, :, None]
    inputs = w.inputs[x]
    flat = np.empty((steps, lanes, n), h.dtype)
    saved = []
    for t in range(steps):
        flat[t], back = _moved(w, h * kept[t], inputs[t])
        h = flat[t]
        saved.append(back)
    flat, goal = flat.reshape(-1, n), y.reshape(-1)
    scale = np.float32(1.0 / len(goal)) if flat.dtype == np.float32 else 1.0 / len(goal)
    off = flat @ w.to_class
    off += w.class_bias
    targets = class_of[goal]
    loss = -_softmax(off, targets).sum()
    off[np.arange(len(goal)), targets] -= 1.0
    off *= scale
    d_class, d_class_bias = flat.T @ off, off.sum(axis=0)
    d_flat = off @ w.to_class.T
    d_word, d_word_bias = np.zeros_like(w.to_word), np.zeros_like(w.word_bias)
    order, classes = by_class(layout, class_of, goal)
    ordered, goals = flat[order], goal[order]
    for g, start, end in classes:
        lo, hi = layout.edges[g], layout.edges[g + 1]
        states, inside = ordered[start:end], goals[start:end] - lo
        off = states @ w.to_word[:, lo:hi]
        off += w.word_bias[lo:hi]
        loss -= _softmax(off, inside).sum()
        off[np.arange(end - start), inside] -= 1.0
        off *= scale
        d_word[:, lo:hi] = states.T @ off
        d_word_bias[lo:hi] = off.sum(axis=0)
        d_flat[order[start:end]] += off @ w.to_word[:, lo:hi].T
    d_states = d_flat.reshape(steps, lanes, n)
    # gradients at the gates: as the recurrent weights see them, and of the candidate's input
    d_gates = np.empty((steps, lanes, 3 * n), h.dtype)
    d_inner = np.empty((steps, lanes, n), h.dtype)
    carry = np.zeros((lanes, n), h.dtype)
    back_weights = np.ascontiguousarray(w.recurrent.T)
    for t in range(steps - 1, -1, -1):
        before, z, r, un, c = saved[t]
        du, dc = d_gates[t], d_inner[t]
        d = d_states[t]
        d += carry
        rest = 1 - z
        dz = d * z
        np.multiply(d, rest, out=dc)
        dc *= 1 - c * c
        np.multiply(before - c, dz, out=du[:, :n])
        du[:, :n] *= rest
        np.multiply(dc, r, out=du[:, 2 * n :])
        np.multiply(du[:, 2 * n :], un, out=du[:, n : 2 * n])
        du[:, n : 2 * n] *= 1 - r
        carry = du @ back_weights
        carry += dz
        carry *= kept[t]
    before = np.concatenate([s[0] for s in saved])
    d_recurrent = before.T @ d_gates.reshape(-1, 3 * n)
    d_gates[:, :, 2 * n :] = d_inner
    d_inputs = np.zeros_like(w.inputs)
    # rows of equal symbols next to each other, summed at once
    symbols = x.reshape(-1)
    order = np.argsort(symbols.astype(np.int16) if layout.start < 2**15 else symbols, kind="stable")
    begins = np.nonzero(np.diff(symbols[order], prepend=-1))[0]
    d_inputs[symbols[order][begins]] = np.add.reduceat(
        d_gates.reshape(-1, 3 * n)[order], begins, axis=0
    )
    return [d_inputs, d_recurrent, d_class, d_class_bias, d_word, d_word_bias], h, float(loss)


def train(
    w: Weights,
    layout: Layout,
    documents: list[np.ndarray],
    hidden: int,
    lanes: int = 256,
    window: int = 16,
    passes: int = 1,
    rate: float = 0.01,
    seed: int = 0,
) -> float:
    """Adam over windows of ``lanes`` streams; every token is read ``passes`` times at least.

    Documents are joined in a seeded order; the state is cleared where one begins. The last
    stream is filled up from the first documents; the mean loss of the last window returns.
    """
    documents = [d for d in documents if len(d)]
    total = sum(map(len, documents))
    if not total:
        return 0.0
    rng = np.random.default_rng(seed)
    class_of = layout.class_of()
    first = [np.zeros_like(a) for a in w.arrays()]
    second = [np.zeros_like(a) for a in w.arrays()]
    lanes = max(1, min(lanes, total // (64 * window)))
    length = -(-total // lanes)
    tokens = passes * lanes * length
    done = count = 0
    loss = 0.0
    for _ in range(passes):
        order = rng.permutation(len(documents))
        goal = np.concatenate([documents[i] for i in order])
        seen = np.concatenate(
            [np.concatenate([[layout.start], documents[i][:-1]]) for i in order]
        )
        goal = np.resize(goal, length * lanes).reshape(lanes, length).T
        seen = np.resize(seen, length * lanes).reshape(lanes, length).T
        h = np.zeros((lanes, hidden), np.float32)
        for at in range(0, length, window):
            x, y = seen[at : at + window], goal[at : at + window]
            slopes, h, loss = _window_gradient(w, layout, class_of, h, x, y)
            loss /= x.size
            done += x.size
            count += 1
            speed = rate * max(0.05, 1 - done / tokens)
            norm = np.sqrt(sum(float((s * s).sum()) for s in slopes))
            shrink = min(1.0, 1.0 / max(norm, 1e-9))
            fast, slow = 1 / (1 - 0.9**count), 1 / (1 - 0.999**count)
            for a, s, m, v in zip(w.arrays(), slopes, first, second):
                s *= shrink
                m *= 0.9
                m += 0.1 * s
                s *= s
                s *= 0.001
                v *= 0.999
                v += s
                np.multiply(v, slow, out=s)
                np.sqrt(s, out=s)
                s += 1e-8
                np.divide(m, s, out=s)
                s *= speed * fast
                a -= s
    return loss


def score_documents(
    w: Weights,
    layout: Layout,
    documents: list[np.ndarray],
    hidden: int,
    lanes: int = 512,
    window: int = 64,
) -> np.ndarray:
    """Natural log probability of the symbols of each whole document.

    Documents run side by side, longest first; a window's states are turned into
    probabilities and dropped, the last state goes on into the next window.
    """
    out = np.zeros(len(documents))
    class_of = layout.class_of()
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    for at in range(0, len(order), lanes):
        chosen = order[at : at + lanes]
        lengths = np.array([len(documents[i]) for i in chosen])
        h = np.zeros((len(chosen), hidden), np.float32)
        last = np.full(len(chosen), layout.start)
        for begin in range(0, int(lengths[0]), window):
            live = int((lengths > begin).sum())
            steps = min(window, int(lengths[0]) - begin)
            y = np.full((steps, live), -1, np.int64)
            for j in range(live):
                part = documents[chosen[j]][begin : begin + steps]
                y[: len(part), j] = part
            h, last = h[:live], last[:live]
            states, goals, lane = [], [], []
            for t in range(steps):
                width = int((y[t] >= 0).sum())  # lanes are ordered by length
                moved, _ = step(w, h[:width], last[:width])
                states.append(moved)
                goals.append(y[t, :width])
                lane.append(np.arange(width))
                h = moved
                last = y[t, :width]
            found = log_probabilities(
                w, layout, class_of, np.concatenate(states), np.concatenate(goals)
            )
            out[np.array(chosen[:live])] += np.bincount(np.concatenate(lane), found, minlength=live)
    return out
