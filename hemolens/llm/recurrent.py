"""A small gated recurrent language model in numpy: truncated backpropagation, class-factored softmax.

A model of `width` has `width * width` tokens, numbered so that `token // width` is the class and
`token % width` the place in it: the probability of a token is that of its class times that of the
token in its class, two softmaxes of `width` instead of one over the vocabulary. Many texts run side by side in lanes;
each lane reads one text after the other, and its state is carried from window to window until
the text ends, so a text of any length is scored as a whole.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

HIDDEN = 16
WIDTH = 32
TOKENS = WIDTH * WIDTH
WINDOW = 32
STEP = 4096
#: Exponents of a softmax at a time: they stay in a core's cache.
BLOCK = 50_000
#: Tokens that are scored at a time, at least.
SCORED = 16_384
#: Bound of the mean gradient of a step.
MOST = 0.1
#: Tables of the softmaxes, from groups over classes to tokens.
LEVELS = ("wg", "wc", "ww")


def edges(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each class of tokens and each group of classes begins, and the end of the last."""
    tokens = np.minimum((2 * np.arange((width + 1) // 2 + 1)) ** 2, width * width)
    classes = np.arange(math.isqrt(len(tokens) - 2) + 2) ** 2
    return tokens, np.minimum(classes, len(tokens) - 1)


def shapes(width: int) -> dict[str, tuple[int, ...]]:
    """`wg` has a row a group, `wc` a row a class, `ww` a row a token: weights, then the bias."""
    classes, groups = (len(x) - 1 for x in edges(width))
    return {
        "x": (width * width, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN),
        "wg": (groups, HIDDEN + 1), "wc": (classes, HIDDEN + 1), "ww": (width * width, HIDDEN + 1),
    }


#: Of the width that a model has where none is given.
SHAPES = shapes(WIDTH)


def start_model(seed: int = 1, width: int = WIDTH) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {k: rng.standard_normal(s, np.float32) * np.float32(0.15) for k, s in shapes(width).items()}
    for k in LEVELS:
        model[k][:, -1] = 0
    return model


def with_frequencies(model: dict, counts: np.ndarray) -> dict:
    """`model` whose biases alone give each token its share of `counts` (smoothed by one)."""
    share, out = counts + 1.0, dict(model)
    classes, groups = edges(math.isqrt(len(counts)))
    for k, begins in (("ww", classes), ("wc", groups), ("wg", None)):
        out[k] = model[k].copy()
        out[k][:, -1] = np.log(share)
        share = share if begins is None else np.add.reduceat(share, begins[:-1])
    return out


def flat(model: dict) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in SHAPES])


def shaped(values, width: int = WIDTH) -> dict[str, np.ndarray]:
    out, at = {}, 0
    values = np.asarray(values, np.float32)
    for k, s in shapes(width).items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s)
        at += n
    return out


def lanes_of(texts: list[np.ndarray], most: int, numbered: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """(tokens, text number if asked for, first-of-text, lane lengths) with a lane a column, longest lane first."""
    n = min(most, len(texts))
    heap = [(0, k) for k in range(n)]
    content: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        size, k = heapq.heappop(heap)
        content[k].append(i)
        heapq.heappush(heap, (size + len(texts[i]), k))
    sizes = np.array([sum(len(texts[i]) for i in c) for c in content])
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max())
    tokens = np.zeros((longest, n), np.int32)
    number = np.zeros((longest, n), np.int32) if numbered else None
    first = np.zeros((longest, n), bool)
    for lane, k in enumerate(order):
        at = 0
        for i in content[k]:
            end = at + len(texts[i])
            tokens[at:end, lane], first[at, lane] = texts[i], True
            if numbered:
                number[at:end, lane] = i
            at = end
    return tokens, number, first, sizes[order]


def run_window(model, tokens, first, h, keep: bool):
    """States before each token, the state after the last, and what the way back needs.

    Inside, lanes are the last axis, so that every part of a gate is one run of memory.
    """
    steps, lanes = tokens.shape
    n, half = HIDDEN, h.dtype.type(0.5)
    x = np.ascontiguousarray(model["x"].take(tokens, axis=0).transpose(0, 2, 1))
    ut = np.ascontiguousarray(model["u"].T)
    x[:, : 2 * n] *= half  # the logistic function of a sum is (1 + tanh(sum / 2)) / 2
    ut[: 2 * n] *= half
    before = np.empty((steps, n, lanes), h.dtype)
    saved = tuple(np.empty((steps, k, lanes), h.dtype) for k in (2 * n, n, n)) if keep else None
    zr, gn, new = (np.empty((k, lanes), h.dtype) for k in (2 * n, n, n))
    h, g = h.T.copy(), np.empty((3 * n, lanes), h.dtype)
    starts = first.any(1)
    for t in range(steps):
        if starts[t]:
            h *= ~first[t]
        before[t] = h
        if keep:
            zr, gn, new = saved[0][t], saved[1][t], saved[2][t]
            np.matmul(ut[2 * n :], h, out=gn)
            np.matmul(ut[: 2 * n], h, out=zr)
        else:
            np.matmul(ut, h, out=g)
            zr, gn = g[: 2 * n], g[2 * n :]
        zr += x[t, : 2 * n]
        np.tanh(zr, zr)
        zr += 1
        zr *= half
        np.multiply(zr[n:], gn, out=new)
        new += x[t, 2 * n :]
        np.tanh(new, new)
        h -= new
        h *= zr[:n]
        h += new
    return np.ascontiguousarray(before.transpose(0, 2, 1)), h.T, saved and (before, *saved)


def outputs(model, states, tokens, gradient: bool, ready=None, weight: float = 1.0):
    """Log-probability of each token (natural), and the gradients of their negative sum, times `weight`.

    `ready`, if given, gets those of the output tables part by part, as (table, first row, end,
    gradient, tokens), when nothing will read those rows any more; the array of the gradient is used again.
    """
    kind_of, n = states.dtype, len(tokens)
    classes, groups = edges(math.isqrt(len(model["ww"])))
    order = order_of(tokens)
    place = np.empty_like(order)
    place[order] = np.arange(n)
    ids = tokens.take(order)
    s = np.ones((n, HIDDEN + 1), kind_of)
    s[:, :HIDDEN] = states.take(order, axis=0)
    # in the order of tokens, a class is a stretch of rows, and so is a group
    of_class = np.searchsorted(ids, classes)
    of_group = of_class[groups]
    in_class, in_group = np.diff(of_class), np.diff(of_group)
    kind, group = np.repeat(np.arange(len(in_class)), in_class), np.repeat(np.arange(len(in_group)), in_group)
    own = model["ww"].take(ids, axis=0)
    own += model["wc"].take(kind, axis=0)
    own += model["wg"].take(group, axis=0)
    logp = np.einsum("ij,ij->i", s, own)
    chosen = group, kind - groups[group], ids - classes[kind]
    parts = [(0, 0, n, 0, len(in_group))]
    for level, rows, begins in ((1, of_group, groups), (2, of_class, classes)):
        parts += [(level, *rows[c : c + 2].tolist(), *begins[c : c + 2].tolist()) for c in np.flatnonzero(np.diff(rows)).tolist()]
    most = max(j - i for *_, i, j in parts)
    ones, sums = np.ones(most, kind_of), np.empty((3, n), kind_of)
    grads = back = None
    if gradient:
        grads = {}
        if ready is None:
            grads = {k: np.zeros(model[k].shape, kind_of) for k in LEVELS}
            ready = lambda k, i, j, g, _: grads[k].__setitem__(slice(i, j), g)
        back, buffer = np.empty((3, n, HIDDEN + 1), kind_of), np.empty((most, HIDDEN + 1), kind_of)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for level, low, high, i, j in parts:
            w, one = model[LEVELS[level]][i:j], ones[: j - i]
            step = max(16, BLOCK // (j - i))
            for a in range(low, high, step):
                b = min(a + step, high)
                rows, total = s[a:b], sums[level, a:b]
                v = rows @ w.T
                np.exp(v, v)
                np.matmul(v, one, out=total)
                share = np.reciprocal(total)
                if not math.isfinite(total @ total + share @ share):  # only then are exponents shifted by their largest
                    v = rows @ w.T
                    shift = v.max(1)
                    v -= shift[:, None]
                    np.exp(v, v)
                    np.matmul(v, one, out=total)
                    share = np.reciprocal(total)
                    logp[a:b] -= shift
                if gradient:
                    v.ravel()[np.arange(0, v.size, j - i) + chosen[level][a:b]] -= total
                    np.matmul(v, w, out=back[level, a:b])
                    share *= weight
                    if a == low:
                        g = np.matmul(v.T, rows * share[:, None], out=buffer[: j - i])
                    else:
                        g += v.T @ (rows * share[:, None])
            if gradient and high > low:
                ready(LEVELS[level], i, j, g, high - low)
    logp -= np.log(sums).sum(0)
    if gradient:
        back *= (weight / sums)[:, :, None]
        back = back.sum(0)[:, :HIDDEN].take(place, axis=0)
    return logp.take(place), grads, back


def order_of(tokens: np.ndarray) -> np.ndarray:
    """A stable argsort, by one sort of numbers."""
    both = tokens.astype(np.int64) << 32
    both |= np.arange(len(tokens))
    both.sort()
    both &= 0xFFFFFFFF
    return both


def run_starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def run_sums(rows: np.ndarray, starts: np.ndarray, short: int = 8) -> np.ndarray:
    """Sum of the rows of each run: short runs all at once, row by row of a run, others one by one."""
    sizes = np.diff(starts, append=len(rows))
    out = rows[starts]
    at = np.flatnonzero((sizes > 1) & (sizes <= short))
    for k in range(1, short):
        out[at] += rows[starts[at] + k]
        at = at[sizes[at] > k + 1]
        if not len(at):
            break
    for i in np.flatnonzero(sizes > short).tolist():
        np.add.reduce(rows[starts[i] : starts[i] + sizes[i]], axis=0, out=out[i])
    return out


def backward(model, tokens, first, before, saved, back, grads) -> None:
    ids, sums = backward_rows(model, tokens, first, before, saved, back, grads)
    grads["x"] = np.zeros(model["x"].shape, sums.dtype)
    grads["x"][ids] = sums


def backward_rows(model, tokens, first, before, saved, back, grads) -> tuple[np.ndarray, np.ndarray]:
    """Adds the gradient of `u` to `grads`; returns the tokens of the window and the gradients of their rows of `x`."""
    steps, lanes = tokens.shape
    n = HIDDEN
    h, zr, gn, new = saved
    z, r = zr[:, :n], zr[:, n:]
    back = np.ascontiguousarray(back.transpose(0, 2, 1))
    to_z = (h - new) * z * (1 - z)
    to_new = (1 - z) * (1 - new * new)
    to_r = gn * r * (1 - r)
    dg, dx_new = np.empty((steps, 3 * n, lanes), back.dtype), np.empty((steps, n, lanes), back.dtype)
    dh, step = np.zeros((n, lanes), back.dtype), np.empty((n, lanes), back.dtype)
    u = model["u"]
    starts = first.any(1)
    for t in range(steps - 1, -1, -1):
        dnew = np.multiply(dh, to_new[t], dx_new[t])
        g = dg[t]
        np.multiply(dh, to_z[t], g[:n])
        np.multiply(dnew, to_r[t], g[n : 2 * n])
        np.multiply(dnew, r[t], g[2 * n :])
        dh *= z[t]
        dh += np.matmul(u, g, out=step)
        dh += back[t]
        if starts[t]:
            dh *= ~first[t]
    rows = dg.transpose(0, 2, 1).reshape(-1, 3 * n)
    grads["u"] = before.reshape(-1, n).T @ rows
    rows[:, 2 * n :] = dx_new.transpose(0, 2, 1).reshape(-1, n)  # from here on the gradient of what the tokens add
    flat_tokens = tokens.ravel()
    order = order_of(flat_tokens)
    begins = run_starts(flat_tokens[order])
    return flat_tokens[order[begins]], run_sums(rows[order], begins)


class Trainer:
    """Adam over truncated windows; the state of every lane is carried on.

    Only tokens and classes that a window has are updated by it, so a step does not grow with the
    vocabulary; each has its own count of steps, for the correction of its averages. Windows of
    fewer than `STEP` tokens, such as those at the end of one long text, take shorter steps.
    """

    #: What corrects the averages after so many steps; it is one from the last on.
    CORRECTION = [0.0, *(math.sqrt(1 - 0.999**k) / (1 - 0.9**k) for k in range(1, 20_000))]

    def __init__(self, model: dict, rate: float):
        self.model = {k: v.copy() for k, v in model.items()}
        self.m = {k: np.zeros_like(v) for k, v in model.items()}  # ten times the average of the gradients
        self.v = {k: np.zeros_like(v) for k, v in model.items()}  # a thousand times the average of their squares
        #: counted for each token of `x`, each part of an output table by its first row, and `u`
        self.steps = {k: np.zeros(len(v), np.int32) if k == "x" else [0] * len(v) for k, v in model.items()}
        self.corrections = np.array(self.CORRECTION, np.float32)
        self.rate, self.seen, self.loss = rate, 0, 0.0

    def learn(self, texts: list[np.ndarray], lanes: int = 192) -> None:
        texts = [t for t in texts if len(t)]
        if not texts:
            return
        tokens, _, first, sizes = lanes_of(texts, lanes, numbered=False)
        h = np.zeros((tokens.shape[1], HIDDEN), np.float32)
        for t in range(0, len(tokens), WINDOW):
            live = int((sizes > t).sum())
            stop = min(t + WINDOW, len(tokens))
            tok, fst = tokens[t:stop, :live], first[t:stop, :live]
            before, h, saved = run_window(self.model, tok, fst, h[:live], True)
            at = slice(None)
            if sizes[live - 1] < stop:
                at = np.flatnonzero((np.arange(t, stop)[:, None] < sizes[None, :live]).ravel())
            states, ids = before.reshape(-1, HIDDEN), tok.ravel()[at]
            n = len(ids)

            def ready(k, i, j, g, tokens, n=n):
                if tokens > MOST * n:  # else no mean is as large as that, as no state is larger than one
                    np.clip(g, -MOST, MOST, out=g)
                adam(self.model[k][i:j], self.m[k][i:j], self.v[k][i:j], g, self.rate_of(k, i, n))

            logp, grads, back = outputs(self.model, states[at], ids, True, ready, 1 / n)
            if len(back) < len(states):
                whole = np.zeros_like(states)
                whole[at] = back
                back = whole
            chosen, g = backward_rows(self.model, tok, fst, before, saved, back.reshape(before.shape), grads)
            ready("u", 0, HIDDEN, grads["u"], n)
            x = [table["x"] for table in (self.model, self.m, self.v)]
            rows = [table.take(chosen, axis=0) for table in x]
            np.clip(g, -MOST, MOST, out=g)
            adam(*rows, g, self.rate_of("x", chosen, n)[:, None])
            for table, new in zip(x, rows):
                table[chosen] = new
            self.seen += n
            self.loss -= float(logp.sum())

    def rate_of(self, k: str, at, n: int):
        """Counts a step of `n` tokens at these places of a table; how far it goes."""
        full = self.rate * min(1.0, n / STEP) * 0.1 / 0.001**0.5
        if isinstance(at, int):
            steps = self.steps[k][at] = min(self.steps[k][at] + 1, len(self.CORRECTION) - 1)
            return np.float32(full * self.CORRECTION[steps])
        self.steps[k][at] += 1
        return np.float32(full) * self.corrections.take(self.steps[k][at], mode="clip")


def adam(w, m, v, g, rate) -> None:
    """A step of Adam against the gradient `g` on all of these tables, in place; `g` is used up."""
    m *= 0.9
    m += g
    v *= 0.999
    g *= g
    v += g
    np.sqrt(v, g)
    g += 1e-7 / 0.001**0.5
    np.divide(m, g, g)
    g *= rate
    w -= g


def score_texts(model: dict, texts: list[np.ndarray], lanes: int = 512) -> np.ndarray:
    """Natural log-likelihood of each whole text."""
    total = np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if len(t)]
    if not at:
        return total
    tokens, number, first, sizes = lanes_of([texts[i] for i in at], lanes)
    h = np.zeros((tokens.shape[1], HIDDEN), np.float32)
    sums, waiting = np.zeros(len(at)), []
    for t in range(0, len(tokens), WINDOW):
        live = int((sizes > t).sum())
        stop = min(t + WINDOW, len(tokens))
        tok = tokens[t:stop, :live]
        before, h, _ = run_window(model, tok, first[t:stop, :live], h[:live], False)
        valid = slice(None) if sizes[live - 1] >= stop else (np.arange(t, stop)[:, None] < sizes[None, :live]).ravel()
        waiting.append((before.reshape(-1, HIDDEN)[valid], tok.ravel()[valid], number[t:stop, :live].ravel()[valid]))
        if stop == len(tokens) or sum(len(x) for _, x, _ in waiting) >= SCORED:
            states, ids, texts_of = (np.concatenate(x) for x in zip(*waiting))
            waiting = []
            sums += np.bincount(texts_of, outputs(model, states, ids, False)[0], len(at))
    total[at] = sums
    return total
