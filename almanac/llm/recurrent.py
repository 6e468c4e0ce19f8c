"""A gated recurrent language model over word ids, in numpy, with a softmax factored into word classes."""

from __future__ import annotations

import dataclasses

import numpy as np

#: Texts that are scored side by side; steps that their state is carried on before the outputs are worked out, and the
#: words that make it worth while: with few texts left, more steps; rows whose class outputs are worked out together, so
#: that they stay in a core's cache; steps and most lanes of a training window; learning rate.
ABREAST, WINDOW, WORTH, ROWS, STEPS, LANES, RATE = 1024, 8, 16_384, 1024, 20, 384, 0.3


@dataclasses.dataclass
class Shape:
    """Ids 0 to words - 1 are words with an output of their own, `per` to a class in order; then come `tails` classes
    of rarer words, one id each, and the end of the text. The start of a text is an input only."""

    words: int
    per: int
    tails: int
    hidden: int

    @property
    def heads(self) -> int:
        return -(-self.words // self.per)

    @property
    def classes(self) -> int:
        return self.heads + self.tails + 1

    @property
    def end(self) -> int:
        return self.words + self.tails

    @property
    def start(self) -> int:
        return self.end + 1

    def sizes(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {"wx": (self.start + 1, 3 * h), "u": (h, 3 * h), "wc": (h, self.classes), "bc": (self.classes,), "ww": (self.heads, h, self.per), "bw": (self.heads, self.per)}

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.words, ids // self.per, self.heads + ids - self.words)


def unpack(shape: Shape, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, size in shape.sizes().items():
        n = int(np.prod(size))
        out[name] = flat[at : at + n].reshape(size)
        at += n
    return out


def initial(shape: Shape, mass: np.ndarray, seed: int = 5) -> np.ndarray:
    """Small random weights, and output biases that give each id its share of the mass: a unigram model at first."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(sum(int(np.prod(s)) for s in shape.sizes().values()), np.float32)
    p = unpack(shape, flat)
    for name in ("wx", "u", "wc", "ww"):
        p[name][...] = rng.normal(0, 0.1, p[name].shape)
    by_class = np.bincount(shape.class_of(np.arange(shape.start)), mass, shape.classes)
    p["bc"][...] = np.log(np.maximum(by_class, 0.5) / max(mass.sum(), 1))
    padded = np.full(shape.heads * shape.per, 1e-9)
    padded[: shape.words] = np.maximum(mass[: shape.words], 0.5)
    p["bw"][...] = np.log(padded.reshape(shape.heads, shape.per) / np.maximum(padded.reshape(shape.heads, shape.per).sum(axis=1, keepdims=True), 1e-9))
    return flat


def _exponentials(x: np.ndarray, bias: np.ndarray, factor: np.ndarray, most: float, goal: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray]:
    """Puts exponentials in the place of x, outputs without their bias; returns the logarithm of each row's goal, where
    goals are given, and what the exponentials of a column are to be multiplied by: factor, the exponential of the bias.
    most: a bound of the outputs, beyond which rows are moved before the exponential."""
    if most > 60:
        x += bias
        x -= x.max(axis=1, keepdims=True)
        bias, factor = np.zeros_like(bias), np.ones_like(factor)
    picked = None if goal is None else x.ravel().take(np.arange(0, x.size, x.shape[1]) + goal) + bias[goal]
    np.exp(x, out=x)
    return picked, factor


def _sums(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows (in columns: numbers x rows) of each id."""
    return np.stack([np.bincount(ids, x, n) for x in rows], axis=1)


def _outputs(shape: Shape, p: dict, h: np.ndarray, goal: np.ndarray, grad: dict | None = None):
    """Natural log probability of each goal given its state; or, with grad, the gradient of h, all others being added to grad.

    Rows are ordered by goal, so that those of a class lie together. With e the exponentials of a softmax, f the factor
    of its columns and t = e f, the gradients are products of e with f w and of e with the states by t, less what the
    goals themselves take away: the exponentials needn't be scaled one by one.
    """
    n, k = h.shape
    order = np.argsort(goal.astype(np.uint16), kind="stable")
    goal = goal[order]
    kind, word = shape.class_of(goal), goal % shape.per
    h = h.take(order, axis=0)
    wc, bc, ww, bw = p["wc"], p["bc"], p["ww"], p["bw"]
    # states lie between -1 and 1, so the weights bound all outputs, without a look at them
    most = float((np.abs(wc).sum(axis=0) + np.abs(bc)).max())
    most_in = (np.abs(ww).sum(axis=1) + np.abs(bw)).max(axis=1).tolist()
    outer, inner = np.exp(np.minimum(bc, 60)), np.exp(np.minimum(bw, 60))
    edges = np.searchsorted(kind, np.arange(shape.heads + 1)).tolist()
    own = edges[-1]
    stretches = [(None, lo, min(lo + ROWS, n)) for lo in range(0, n, ROWS)]
    stretches += [(c, lo, hi) for c, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if lo < hi]
    out, dh = np.zeros(n, h.dtype), np.zeros((n, k), h.dtype)
    if grad is not None:
        one = np.ones((n, k + 1), h.dtype)
        one[:, :k] = h
    for c, lo, hi in stretches:
        inside = c is not None
        w, b, f, bound, at = (ww[c], bw[c], inner[c], most_in[c], word) if inside else (wc, bc, outer, most, kind)
        e = h[lo:hi] @ w
        if grad is None:
            picked, f = _exponentials(e, b, f, bound, at[lo:hi])
            picked -= np.log(e @ f)
            out[lo:hi] += picked
            continue
        _, f = _exponentials(e, b, f, bound, None)
        back = np.empty((len(f), k + 1), h.dtype)
        np.multiply(w.T, f[:, None], out=back[:, :k])
        back[:, k] = f
        back = e @ back
        total = back[:, k:].copy()
        back /= total
        dh[lo:hi] += back[:, :k]
        g = (one[lo:hi] / total).T @ e
        g *= f
        if inside:
            grad["ww"][c] += g[:k]
            grad["bw"][c] += g[k]
        else:
            grad["wc"] += g[:k]
            grad["bc"] += g[k]
    if grad is None:
        given = np.empty_like(out)
        given[order] = out
        return given, None
    # what the goals take away
    by_goal = _sums(goal, one.T, shape.start)
    kinds = shape.class_of(np.arange(shape.start))
    by_class = np.add.reduceat(by_goal, np.flatnonzero(np.diff(kinds, prepend=-1)))
    grad["wc"] -= by_class[:, :k].T
    grad["bc"] -= by_class[:, k]
    by_word = np.zeros((shape.heads * shape.per, k + 1))
    by_word[: shape.words] = by_goal[: shape.words]
    by_word = by_word.reshape(shape.heads, shape.per, k + 1)
    grad["ww"] -= by_word[:, :, :k].transpose(0, 2, 1)
    grad["bw"] -= by_word[:, :, k]
    dh -= np.ascontiguousarray(wc.T)[kind]
    dh[:own] -= np.ascontiguousarray(ww.transpose(0, 2, 1)).reshape(-1, k)[goal[:own]]
    given = np.empty_like(dh)
    given[order] = dh
    return None, given


@np.errstate(over="ignore")
def score(shape: Shape, flat: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of whole texts (arrays of word ids, without the end). Texts of like length advance
    together, the longest first; the state is carried from window to window to the end of each."""
    p, k = unpack(shape, flat), shape.hidden
    n = np.array([len(t) for t in texts], np.int64)
    order, out = np.argsort(-n, kind="stable"), np.empty(len(texts))
    # the gates' weights are negative, as their exponentials take them; in parts of their own, so that rows lie together
    wx, u = ((-p[w][:, : 2 * k], np.ascontiguousarray(p[w][:, 2 * k :])) for w in ("wx", "u"))
    for lo in range(0, len(texts), ABREAST):
        some = order[lo : lo + ABREAST]
        out[some] = _abreast(shape, p, wx, u, [texts[i] for i in some.tolist()], n[some] + 1)
    return out


def _abreast(shape: Shape, p: dict, wx: tuple, u: tuple, texts: list[np.ndarray], steps: np.ndarray) -> np.ndarray:
    """score() of a few texts, the longest first. steps: their words and the end."""
    k = shape.hidden
    goals = np.full((int(steps[0]), len(texts)), shape.end, np.int32)
    for i, text in enumerate(texts):
        goals[: len(text), i] = text
    h, total = np.zeros((len(texts), k), p["wx"].dtype), np.zeros(len(texts))
    now, left = np.full(len(texts), shape.start), np.searchsorted(-steps, -np.arange(int(steps[0])), side="left").tolist()
    t0 = 0
    while t0 < len(goals):
        first, t0 = t0, t0 + max(WINDOW, WORTH // left[t0])
        states, wanted = [], []
        for t, live in enumerate(left[first:t0], first):
            h, now = h[:live], now[:live]
            gates = h @ u[0]
            gates += wx[0].take(now, axis=0)
            # far below zero the exponential overflows to infinity, and the gate is zero
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            own = h @ u[1]
            own *= gates[:, :k]
            own += wx[1].take(now, axis=0)
            np.tanh(own, out=own)
            h = own + gates[:, k:] * (h - own)
            now = goals[t, :live]
            states.append(h)
            wanted.append(now)
        got, _ = _outputs(shape, p, np.concatenate(states), np.concatenate(wanted))
        total += np.bincount(np.concatenate([np.arange(len(x)) for x in wanted]), got, len(texts))
    return total


@np.errstate(over="ignore")
def gradients(shape: Shape, p: dict, inputs: np.ndarray, goals: np.ndarray, valid: np.ndarray, h: np.ndarray, grad: dict) -> np.ndarray:
    """Adds the gradients of minus the log probability of a window (steps x lanes) to grad; returns the state after it.

    States are columns here (hidden x steps x lanes), so that the parts of the gates are whole rows. A lane's state is
    zero where its input is the start of a text, and no gradient flows back over that place.
    """
    (n, lanes), k = inputs.shape, shape.hidden
    # the gates' weights are negative, as their exponentials take them
    wx, u = (np.ascontiguousarray(p[w].T) for w in ("wx", "u"))
    wx[: 2 * k] *= -1
    u_gates, u_own = -u[: 2 * k], u[2 * k :]
    ids = inputs.ravel()
    # what the inputs add; in its place, step by step, the gates and the new part of the state
    given = wx.take(ids, axis=1).reshape(3 * k, n, lanes)
    keep = (inputs != shape.start).astype(h.dtype)
    before, states, rest = (np.empty((k, n, lanes), h.dtype) for _ in range(3))
    r, z, own = given[:k], given[k : 2 * k], given[2 * k :]
    for t in range(n):
        last, gates, new = before[:, t], given[: 2 * k, t], own[:, t]
        np.multiply(h, keep[t], out=last)
        gates += u_gates @ last
        # far below zero the exponential overflows to infinity, and the gate is zero
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.matmul(u_own, last, out=rest[:, t])
        new += r[:, t] * rest[:, t]
        np.tanh(new, out=new)
        h = last - new
        h *= z[:, t]
        h += new
        states[:, t] = h
    by_word, dh_all = np.ascontiguousarray(states.reshape(k, -1).T), np.zeros((n * lanes, k), h.dtype)
    use = valid.ravel()
    if use.all():
        dh_all = _outputs(shape, p, by_word, goals.ravel(), grad)[1]
    else:
        _, dh_all[use] = _outputs(shape, p, by_word[use], goals.ravel()[use], grad)
    dh_all = np.ascontiguousarray(dh_all.T).reshape(k, n, lanes)
    # what a state's gradient is multiplied by, for all steps at once; in its place, step by step, the gradients
    da = np.empty((3, k, n, lanes), h.dtype)
    np.multiply(1 - z, 1 - own * own, out=da[2])
    np.multiply(da[2] * rest, r * (1 - r), out=da[0])
    np.multiply(before - own, z * (1 - z), out=da[1])
    dh, back_gates, back_own, through = np.zeros_like(h), np.ascontiguousarray(u[: 2 * k].T), np.ascontiguousarray(u_own.T), rest
    flat = da.reshape(3 * k, n, lanes)
    for t in reversed(range(n)):
        dh = dh + dh_all[:, t]
        da[:, :, t] *= dh
        np.multiply(da[2, :, t], r[:, t], out=through[:, t])
        dh *= z[:, t]
        dh += back_gates @ flat[: 2 * k, t]
        dh += back_own @ through[:, t]
        dh *= keep[t]
    held = before.reshape(k, -1)
    grad["u"][:, : 2 * k] += held @ flat[: 2 * k].reshape(2 * k, -1).T
    grad["u"][:, 2 * k :] += held @ through.reshape(k, -1).T
    grad["wx"] += _sums(ids, flat.reshape(3 * k, -1), shape.start + 1)
    return h


def train(shape: Shape, flat: np.ndarray, texts: list[np.ndarray], rate: float = RATE, lanes: int = LANES) -> tuple[np.ndarray, int]:
    """One pass of truncated backpropagation over the texts; returns new weights and the number of tokens learnt from.

    The texts, each with its end, are laid end to end and dealt to lanes of equal length that run side by side, with
    fewer lanes where the texts are few. Gradients flow within a window of STEPS words, the state flows on to the next
    window, and starts anew with every text.
    """
    flat = flat.copy()
    p = unpack(shape, flat)
    memory = np.full_like(flat, 1e-2)
    total = sum(map(len, texts)) + len(texts)
    lanes = max(1, min(lanes, total // (16 * STEPS)))
    length = -(-total // lanes)
    goals, inputs = np.full(lanes * length, shape.end), np.full(lanes * length, shape.start)
    at = 0
    for turn in np.random.default_rng(total).permutation(len(texts)):
        n = len(texts[turn])
        goals[at : at + n] = texts[turn]
        inputs[at + 1 : at + n + 1] = texts[turn]
        at += n + 1
    valid = np.arange(lanes * length) < total
    goals, inputs, valid = (x.reshape(lanes, length).T for x in (goals, inputs, valid))
    h = np.zeros((shape.hidden, lanes), np.float32)
    grad_flat = np.empty_like(flat)
    grad = unpack(shape, grad_flat)
    for t0 in range(0, length, STEPS):
        span = slice(t0, t0 + STEPS)
        grad_flat[:] = 0
        h = gradients(shape, p, inputs[span], goals[span], valid[span], h, grad)
        grad_flat /= max(1, valid[span].sum()) ** 0.5
        np.clip(grad_flat, -5, 5, out=grad_flat)
        memory += grad_flat * grad_flat
        flat -= rate * grad_flat / np.sqrt(memory)
    return flat, total
