"""A gated recurrent language model in numpy, with a class-factored output.

p(word | state) = p(class | state) p(word | class, state). The most frequent words, the head, have classes that are
stretches by frequency, each with about the same sum of square roots of counts, and a softmax in each. All other words
are in bands by their counts; each band is one more class, whose words share it in fixed proportions that are not
part of the model. Parameters start at the unigram model: biases are log counts, output weights zero.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

HIDDEN = 16
#: Classes of the head.
CLASSES = 72
#: Steps of a window: gradients stop at its start, the state goes on into the next.
WINDOW = 16
#: Texts read side by side in training, at most, and tokens of one of them, at least.
LANES, LANE_TOKENS = 384, 2000
RATE = 0.15
#: Texts scored side by side.
SCORED = 512
#: Tokens whose outputs are computed together when texts are scored.
TOGETHER = 12_000
#: Rows of class logits that are computed together, so that they stay in the cache.
BESIDE = 1024
#: Parameters that are changed together, likewise.
STEPPED = 1 << 14
#: Where exp() of a logit would overflow, all are kept below this.
MOST_LOGIT = np.float32(80)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Of a scratch array, in place. Where exp() overflows it is 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Layout:
    """Numbers and classes. counts: of the head's words, descending; rare: of all words of each band.

    Words of the head have the numbers from 0, bands follow, then the start of a text, which is only read.
    """

    def __init__(self, counts: np.ndarray, rare: float | np.ndarray) -> None:
        rare = np.atleast_1d(np.asarray(rare, float))
        self.n, self.start_number = len(counts), len(counts) + len(rare)
        root = np.cumsum(np.sqrt(counts)) if self.n else np.zeros(0)
        part = np.minimum((root / root[-1] * CLASSES).astype(np.int64), CLASSES - 1) if self.n else np.zeros(0, np.int64)
        names, part = np.unique(part, return_inverse=True) if self.n else (part, part)
        self.heads = len(names)
        self.classes = self.heads + len(rare)
        self.of = np.concatenate([part, self.heads + np.arange(len(rare))]).astype(np.int64)
        self.edge = np.concatenate([np.searchsorted(part, np.arange(self.heads)), [self.n]]).astype(np.int64)
        mass = np.concatenate([np.bincount(part, weights=counts, minlength=self.heads)[: self.heads], rare]) + 0.5
        self.class_bias = np.log(mass / mass.sum())
        self.ones = np.ones(max(self.classes, int(np.diff(self.edge).max(initial=0))), np.float32)
        self.word_bias = np.log(counts / mass[part]) if self.n else np.zeros(0)

    def start(self) -> dict[str, np.ndarray]:
        """First parameters."""
        g = np.random.default_rng(7)
        draw = lambda *s: g.normal(0, 0.1, s).astype(np.float32)
        return {
            "table": draw(self.start_number + 1, 3 * HIDDEN), "turn": draw(HIDDEN, 3 * HIDDEN), "turn_bias": np.zeros(3 * HIDDEN, np.float32), "to_class": np.zeros((HIDDEN, self.classes), np.float32),
            "class_bias": self.class_bias.astype(np.float32), "to_word": np.zeros((self.n, HIDDEN), np.float32), "word_bias": self.word_bias.astype(np.float32),
        }


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def shaped(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def cell(turn: np.ndarray, bias: np.ndarray, x: np.ndarray, h: np.ndarray, gates: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new state, what the reset gates multiply) from table rows x and state h; fills update and reset gates and candidates.

    Lanes are columns everywhere, so that what belongs to a gate is one stretch of memory. turn and bias: transposed.
    """
    n = HIDDEN
    u = turn @ h
    u += bias
    sigmoid(np.add(x[: 2 * n], u[: 2 * n], out=gates))
    np.multiply(gates[n:], u[2 * n :], out=c)
    c += x[2 * n :]
    c *= 2  # tanh(c) = 2 sigmoid(2 c) - 1
    sigmoid(c)
    c *= 2
    c -= 1
    new = h - c
    new *= gates[:n]
    new += c
    return new, u[2 * n :]


def _turned(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(p["turn"].T), p["turn_bias"][:, None]


def _exp(x: np.ndarray, bounded: bool) -> np.ndarray:
    if bounded:
        np.minimum(x, MOST_LOGIT, out=x)
    return np.exp(x, out=x)


def _finite(made: Callable[[bool], tuple]) -> tuple:
    """made(False), or, where sums of exp(logits), which come last, overflow in that, made(True) with bounded logits."""
    with np.errstate(over="ignore", invalid="ignore"):
        *found, sums = made(False)
    if not all(np.isfinite(x).all() for x in sums):
        *found, sums = made(True)
    return tuple(found)


def _joined(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parameters with weights and, as a last column, biases of classes (rows) and of words in one."""
    joined = {"classes": np.column_stack([p["to_class"].T, p["class_bias"]]), "words": np.column_stack([p["to_word"], p["word_bias"]])}
    return {"table": p["table"], "turn": p["turn"], "turn_bias": p["turn_bias"], **joined}


def _parted(p: dict[str, np.ndarray], like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    classes, words = p["classes"], p["words"]
    parts = p | {"to_class": classes[:, :HIDDEN].T, "class_bias": classes[:, HIDDEN], "to_word": words[:, :HIDDEN], "word_bias": words[:, HIDDEN]}
    return {k: np.ascontiguousarray(parts[k]) for k in like}


def _with_one(s: np.ndarray) -> np.ndarray:
    """States (rows), with a column of ones that meets the biases."""
    out = np.ones((len(s), HIDDEN + 1), np.float32)
    out[:, :HIDDEN] = s
    return out


def _row_sums(x: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.dot(x, ones[: x.shape[1]])


def train(p: dict[str, np.ndarray], layout: Layout, texts: list[np.ndarray]) -> tuple[dict[str, np.ndarray], int]:
    """Parameters after one pass over the texts (numbers), and the tokens seen."""
    if not texts:
        return p, 0
    start = layout.start_number
    line = np.concatenate(texts)
    size = np.array([len(t) for t in texts])
    before = np.concatenate([[start], line[:-1]])
    before[np.cumsum(size) - size] = start
    lanes = int(min(LANES, max(4, len(line) // LANE_TOKENS)))
    steps = -(-len(line) // lanes)
    pad = lanes * steps - len(line)
    goal = np.concatenate([line, np.full(pad, -1)]).reshape(lanes, steps)
    given = np.concatenate([before, np.full(pad, start)]).reshape(lanes, steps)
    like, p = p, {k: v.copy() for k, v in _joined(p).items()}
    seen = {k: np.full_like(v, 1e-3) for k, v in p.items()}
    h = np.zeros((lanes, HIDDEN), np.float32)
    for at in range(0, steps, WINDOW):
        h = _window(p, seen, layout, np.ascontiguousarray(given[:, at : at + WINDOW].T), np.ascontiguousarray(goal[:, at : at + WINDOW].T), h)
    return _parted(p, like), len(line)


def gradients(p: dict[str, np.ndarray], layout: Layout, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, list, np.ndarray]:
    """Of -log p of a window, summed over its steps (rows of x: read, and y: to predict, -1 for nothing) and averaged over lanes.

    Gives gradients of the parameters (of the table: rows and theirs), of the words those by stretches (first word, end,
    of weights, of biases), and the state after the window. h is the state before it.
    """
    g, h = _gradients(_joined(p), layout, x, y, h)
    g |= {"to_class": g["classes"][:, :HIDDEN].T, "class_bias": g.pop("classes")[:, HIDDEN]}
    words = g.pop("words")
    return g, [(0, layout.n, words[:, :HIDDEN], words[:, HIDDEN])], h


def _gradients(p: dict[str, np.ndarray], layout: Layout, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
    fresh, n, steps, lanes = x == layout.start_number, HIDDEN, *x.shape
    rows = np.ascontiguousarray(p["table"].take(x.ravel(), axis=0).reshape(steps, lanes, 3 * n).transpose(0, 2, 1))
    held, gates, c, u = (np.empty((steps, k * n, lanes), np.float32) for k in (1, 2, 1, 1))
    turn, after, state = _turned(p), np.empty((steps, lanes, n), np.float32), np.ascontiguousarray(h.T)
    with np.errstate(over="ignore"):
        for t in range(steps):
            np.multiply(state, ~fresh[t], out=held[t])
            state, u[t] = cell(*turn, rows[t], held[t], gates[t], c[t])
            after[t] = state.T
    g, d_after = _finite(lambda bounded: _output_gradients(p, layout, after, y, bounded))
    g |= _recurrent_gradients(p, held, gates, c, u, x, d_after, fresh)
    return g, np.ascontiguousarray(state.T)


def _window(p: dict[str, np.ndarray], seen: dict[str, np.ndarray], layout: Layout, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
    g, h = _gradients(p, layout, x, y, h)
    rows, d = g.pop("table")
    now, so_far = p["table"].take(rows, axis=0), seen["table"].take(rows, axis=0)
    _step(now, so_far, d)
    p["table"][rows], seen["table"][rows] = now, so_far
    for k, d in g.items():
        _step(p[k], seen[k], d)
    return h


def _step(p: np.ndarray, seen: np.ndarray, d: np.ndarray) -> None:
    """All three are whole stretches of memory; they are gone through in parts that stay in the cache."""
    p, seen, d, scratch = p.reshape(-1), seen.reshape(-1), d.reshape(-1), np.empty(min(d.size, STEPPED), d.dtype)
    for at in range(0, d.size, STEPPED):
        own, so_far = d[at : at + STEPPED], seen[at : at + STEPPED]
        root = np.multiply(own, own, out=scratch[: len(own)])
        so_far += root
        np.sqrt(so_far, out=root)
        own *= RATE
        own /= root
        p[at : at + STEPPED] -= own


def _by_class(layout: Layout, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Order of cls, and (first word, end, first place in that order, end) of each class of the head with several words."""
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cut = np.searchsorted(cls[order], np.arange(layout.heads + 1)).tolist()
    edge = layout.edge.tolist()
    return order, [(edge[c], edge[c + 1], cut[c], cut[c + 1]) for c in range(layout.heads) if cut[c] < cut[c + 1] and edge[c + 1] - edge[c] > 1]


def _in_class(layout: Layout, w: np.ndarray, cls: np.ndarray, order: np.ndarray, parts: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Where the logit of each word, in that order, is among those of the words of its class in the order, one row after the other."""
    first, width, begin = (np.zeros(layout.classes, np.int64) for _ in range(3))
    of = layout.of[[a for a, *_ in parts]]
    first[of], width[of], begin[of] = [a for a, *_ in parts], [b - a for a, b, *_ in parts], [i for _, _, i, _ in parts]
    own = cls[order]
    return (np.arange(len(w)) - begin[own]) * width[own] + w[order] - first[own]


def _output_gradients(p: dict[str, np.ndarray], layout: Layout, after: np.ndarray, y: np.ndarray, bounded: bool) -> tuple[dict, np.ndarray, list[np.ndarray]]:
    flat_s, w = after.reshape(-1, HIDDEN), y.ravel()
    real = np.flatnonzero(w >= 0)
    s, w = (flat_s, w) if len(real) == len(w) else (flat_s[real], w[real])
    n, cls, s = np.float32(max(1, y.shape[1])), layout.of[w], _with_one(s)
    to_class, to_word, ones = p["classes"], p["words"], layout.ones
    ds, of_class, class_sums, word_sums = np.empty((len(s), HIDDEN), np.float32), np.zeros_like(to_class), np.ones(len(s), np.float32), np.ones(len(s), np.float32)
    # rows of exp(logits) less, at the goal, their sum; what that lacks of a gradient is a factor of the row
    for at in range(0, len(s), BESIDE):
        own, goal = s[at : at + BESIDE], cls[at : at + BESIDE]
        d = _exp(np.dot(own, to_class.T), bounded)
        class_sums[at : at + BESIDE] = sums = _row_sums(d, ones)
        d[np.arange(len(goal)), goal] -= sums
        factor = (1 / n / sums)[:, None]
        np.multiply(np.dot(d, to_class[:, :HIDDEN]), factor, out=ds[at : at + BESIDE])
        of_class += np.dot(d.T, own * factor)
    order, parts = _by_class(layout, cls)
    s, goal = s.take(order, axis=0), _in_class(layout, w, cls, order, parts)
    of_word, back = np.zeros_like(to_word), np.zeros_like(ds)
    for a, b, i, j in parts:
        own, weights = s[i:j], to_word[a:b]
        e = _exp(np.dot(own, weights.T), bounded)
        word_sums[i:j] = sums = _row_sums(e, ones)
        e.reshape(-1)[goal[i:j]] -= sums
        np.matmul(e, weights[:, :HIDDEN], out=back[i:j])
        np.matmul(e.T, own * (1 / n / sums)[:, None], out=of_word[a:b])
    back *= (1 / n / word_sums)[:, None]
    ds[order] += back
    g = {"classes": of_class, "words": of_word}
    if len(real) == y.size:
        return g, ds.reshape(after.shape), [class_sums, word_sums]
    out = np.zeros((y.size, HIDDEN), np.float32)
    out[real] = ds
    return g, out.reshape(after.shape), [class_sums, word_sums]


def _recurrent_gradients(p: dict[str, np.ndarray], held: np.ndarray, gates: np.ndarray, c: np.ndarray, u: np.ndarray, x: np.ndarray, d_after: np.ndarray, fresh: np.ndarray) -> dict:
    n, (z, r) = HIDDEN, (gates[:, :HIDDEN], gates[:, HIDDEN:])
    # what the gradients of update gates, candidates and reset gates are of that of the state
    rest = 1 - z
    to_z, to_c, to_r = held - c, 1 - c * c, u * r
    to_z *= z
    to_z *= rest
    to_c *= rest
    to_r *= 1 - r
    d_after, old = np.ascontiguousarray(d_after.transpose(0, 2, 1)), ~fresh
    du, dc = np.empty((len(x), 3 * n, x.shape[1]), np.float32), np.empty_like(held)
    dh = np.zeros_like(held[0])
    for t in range(len(x) - 1, -1, -1):
        dh += d_after[t]
        np.multiply(dh, to_c[t], out=dc[t])
        own = du[t]
        np.multiply(dh, to_z[t], out=own[:n])
        np.multiply(dc[t], to_r[t], out=own[n : 2 * n])
        np.multiply(dc[t], r[t], out=own[2 * n :])
        dh *= z[t]
        dh += p["turn"] @ own
        dh *= old[t]
    turn, bias = np.matmul(held, du.transpose(0, 2, 1)).sum(axis=0), du.sum(axis=2).sum(axis=0)
    du[:, 2 * n :] = dc
    # table rows: sums over the places of each number
    flat_x = x.ravel()
    times = np.bincount(flat_x)
    rows = np.flatnonzero(times)
    place = np.cumsum(times > 0)[flat_x] - 1
    table = np.empty((len(rows), 3 * n), np.float32)
    for k in range(3 * n):
        table[:, k] = np.bincount(place, weights=du[:, k].ravel(), minlength=len(rows))
    norm = np.float32(max(1.0, float(np.sqrt((turn * turn).sum())) / 5))
    return {"turn": turn / norm, "turn_bias": bias / norm, "table": (rows, table / norm)}


def _dealt(sizes: list[int], lanes: int) -> list[list[int]]:
    """Places of texts by lane: each text, the longest first, to the lane with the least so far. Longest lanes first."""
    load = [(0, k) for k in range(min(lanes, len(sizes)))]
    held: list[list[int]] = [[] for _ in load]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n, k = heapq.heappop(load)
        held[k].append(i)
        heapq.heappush(load, (n + sizes[i], k))
    return [held[k] for _, k in sorted(load, reverse=True)]


def log_likelihoods(p: dict[str, np.ndarray], layout: Layout, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each text: of its words, and of the class alone where a word is in a band."""
    found = np.zeros(len(texts))
    if not texts:
        return found
    lanes = _dealt([len(t) for t in texts], SCORED)
    load = np.array([sum(len(texts[i]) for i in lane) for lane in lanes])
    goal, text = np.zeros((load[0], len(lanes)), np.int64), np.zeros((load[0], len(lanes)), np.int64)
    given = np.full((load[0], len(lanes)), layout.start_number)
    for k, lane in enumerate(lanes):
        at = 0
        for i in lane:
            n = len(texts[i])
            goal[at : at + n, k], text[at : at + n, k] = texts[i], i
            given[at + 1 : at + n, k] = texts[i][:-1]
            at += n
    live = np.searchsorted(-load, -np.arange(load[0]), side="left").tolist()  # longest lanes first
    p = _joined(p)
    h, turn, rows = np.zeros((HIDDEN, len(lanes)), np.float32), _turned(p), p["table"]
    states, at, waiting = [], 0, 0
    with np.errstate(over="ignore"):
        for t, n in enumerate(live):
            h = h[:, :n] * (given[t, :n] != layout.start_number)
            gates, c = np.empty((2 * HIDDEN, n), np.float32), np.empty_like(h)
            h = cell(*turn, np.ascontiguousarray(rows.take(given[t, :n], axis=0).T), h, gates, c)[0]
            states.append(h.T)
            waiting += n
            if t + 1 == len(live) or waiting > TOGETHER:
                w, of = (np.concatenate([a[i, : live[i]] for i in range(at, t + 1)]) for a in (goal, text))
                s = _with_one(np.concatenate(states))
                found += np.bincount(of, weights=_finite(lambda bounded, s=s, w=w: _log_p(layout, p, bounded, s, w))[0], minlength=len(texts))
                states, at, waiting = [], t + 1, 0
    return found


def _log_p(layout: Layout, p: dict[str, np.ndarray], bounded: bool, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    cls, (goals, sums, in_goals, in_sums) = layout.of[w], np.ones((4, len(w)), np.float32)
    to_class, to_word, ones = p["classes"], p["words"], layout.ones
    for at in range(0, len(w), BESIDE):
        x = _exp(np.dot(s[at : at + BESIDE], to_class.T), bounded)
        goals[at : at + BESIDE], sums[at : at + BESIDE] = x[np.arange(len(x)), cls[at : at + BESIDE]], _row_sums(x, ones)
    order, parts = _by_class(layout, cls)
    s, goal = s.take(order, axis=0), _in_class(layout, w, cls, order, parts)
    for a, b, i, j in parts:
        x = _exp(np.dot(s[i:j], to_word[a:b].T), bounded)
        in_goals[i:j], in_sums[i:j] = x.reshape(-1)[goal[i:j]], _row_sums(x, ones)
    out = np.log(np.maximum(goals / sums, 1e-30))
    out[order] += np.log(np.maximum(in_goals / in_sums, 1e-30))
    return out.astype(float), [sums, in_sums]
