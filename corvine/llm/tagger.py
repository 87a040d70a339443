"""A character-level bidirectional LSTM with a CRF on top, in numpy: training and decoding."""

from __future__ import annotations

import numpy as np

from corvine.llm import steps

KINDS = ("name", "email", "phone", "idnum", "address")
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
PAD = 0
_PRINTABLE = "".join(chr(c) for c in range(32, 127))
VOCABULARY = 1 + len(_PRINTABLE) + 8
HIDDEN = 32
# What rounding may add to the score of a path, and more.
SLACK = 0.01


def _table() -> np.ndarray:
    """Class of each code point of the basic plane: ASCII by itself, others by kind."""
    base = 1 + len(_PRINTABLE)
    out = np.full(0x10000, base + 7, np.int16)
    for c in range(0x10000):
        s = chr(c)
        if 32 <= c < 127:
            out[c] = 1 + c - 32
        elif c < 0xD800 or c > 0xDFFF:
            out[c] = base + (0 if s.isspace() else 1 if s.isupper() else 2 if s.islower() else 3 if s.isdigit() else 4 if s.isalpha() and c < 0x2E80 else 5 if s.isalpha() else 6)
    out[10] = base
    return out


CLASSES = _table()


def encode(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(classes, lengths) of the windows, padded on the right."""
    length = np.array([len(w) for w in windows])
    out = np.zeros((len(windows), max(1, int(length.max(initial=1)))), np.int16)
    code = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < length[:, None]] = CLASSES[np.minimum(code, 0xFFFF)]
    return out, length


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def fresh(seed: int = 5, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = len(TAGS)
    w = lambda *s, scale: (rng.normal(size=s) * scale).astype(np.float32)
    p = {
        "P": w(2, VOCABULARY, 4 * hidden, scale=0.3), "U": w(2, hidden, 4 * hidden, scale=hidden**-0.5),
        "W": w(2 * hidden, k, scale=0.2), "b": np.zeros(k, np.float32), "T": w(k, k, scale=0.05), "S": np.zeros(k, np.float32),
    }
    p["P"][:, :, hidden : 2 * hidden] += 0.5
    return p


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row reversed within its length."""
    n, L = x.shape[:2]
    at = np.arange(L)[None, :]
    index = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return x[np.arange(n)[:, None], index]


def lstm(p: dict, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """Hidden states (n, L, 2H) of both directions, which run side by side; with keep also what training needs."""
    n, L = x.shape
    hidden = p["U"].shape[1]
    both = np.stack([x, _reverse(x, lengths)])
    h = np.zeros((2, n, hidden), np.float32)
    c = np.zeros_like(h)
    out = np.empty((L, 2, n, hidden), np.float32)
    saved = []
    for t in range(L):
        g = np.matmul(h, p["U"])
        g[0] += p["P"][0][both[0, :, t]]
        g[1] += p["P"][1][both[1, :, t]]
        s = g[:, :, : 3 * hidden]
        np.multiply(s, 0.5, out=s)
        np.tanh(g, out=g)
        s += 1
        s *= 0.5
        i, f, o, z = (g[:, :, k * hidden : (k + 1) * hidden] for k in range(4))
        before, c = c, f * c + i * z
        tc = np.tanh(c)
        if keep:
            saved.append((h, before, g, tc))
        h = o * tc
        out[t] = h
    states = out.transpose(1, 2, 0, 3)
    joined = np.concatenate([states[0], _reverse(states[1], lengths)], axis=2)
    return (joined, both, saved) if keep else joined


def emissions(p: dict, windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, lengths = encode(windows)
    return lstm(p, x, lengths) @ p["W"] + p["b"], lengths


def viterbi(p: dict, e: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Best tag sequence of each window."""
    n, L, k = e.shape
    score = p["S"] + e[:, 0]
    back = np.zeros((L, n, k), np.int8)
    for t in range(1, L):
        all_ = score[:, :, None] + p["T"][None]
        back[t] = all_.argmax(axis=1)
        nxt = all_.max(axis=1) + e[:, t]
        live = (t < lengths)[:, None]
        score = np.where(live, nxt, score)
    last = score.argmax(axis=1)
    path = np.zeros((n, L), np.int8)
    rows = np.arange(n)
    tag = last
    for t in range(L - 1, -1, -1):
        at_end = lengths - 1 == t
        tag = np.where(at_end, last, tag)
        path[:, t] = tag
        if t:
            tag = np.where(t < lengths, back[t][rows, tag], tag)
    return [path[r, : lengths[r]] for r in range(n)]


class Decoder:
    """The parameters laid out for decoding: one block (windows, hidden) a gate, so that a step works on contiguous blocks.

    Every gate is 1 / (1 + exp(-x)), with tanh(x) = 2 / (1 + exp(-2x)) - 1; the state is kept as -2c and h / 2.
    With onnxruntime the same step runs there, fused; ``plain`` keeps to numpy.
    """

    def __init__(self, p: dict[str, np.ndarray], plain: bool = False):
        hidden = p["U"].shape[1]
        self.steps = [None if plain else steps.step(P, U, W) for P, U, W in zip(p["P"], p["U"], (p["W"][:hidden], p["W"][hidden:]))]
        sign = np.repeat(np.array([-1, -1, -1, -2], np.float32), hidden)
        gates = lambda x: np.ascontiguousarray((x * sign).reshape(len(x), 4, hidden).transpose(1, 0, 2))
        self.P = [gates(x) for x in p["P"]]
        self.U = [gates(2 * x) for x in p["U"]]
        self.W = [np.ascontiguousarray(2 * x.T) for x in (p["W"][:hidden], p["W"][hidden:])]
        self.b, self.T, self.S, self.hidden = p["b"], p["T"], p["S"], hidden
        groups = [slice(0, 1), slice(1, None, 2), slice(2, None, 2)]  # O, all B, all I
        self.into = np.array([[self.T[a, b].max() for a in groups] for b in groups], np.float32) - self.T[0, 0]
        self.first = np.array([self.S[b].max() for b in groups], np.float32) - self.S[0]
        self.into[1:, 0] += SLACK
        self.first[1:] += SLACK

    def direction(self, d: int, x: np.ndarray, lengths: np.ndarray, e: np.ndarray) -> None:
        """Adds one direction's emissions for classes x (L, n) to e (L, tags, n); windows are sorted by length.

        The backward direction starts each window's state at its own end: what lies beyond is set to 0.
        """
        if self.steps[d]:
            return self.stepped(d, x, lengths, e)
        L, n = x.shape
        k = self.hidden
        h, c, top = (np.zeros((n, k), np.float32) for _ in range(3))
        g, q = (np.empty((4, n, k), np.float32) for _ in range(2))
        i, f, o, z = g
        scale = np.array([-4, 1, 1, 1], np.float32)[:, None, None]
        x = x.astype(np.intp)
        out = np.empty((len(TAGS), n), np.float32)
        ended = np.searchsorted(lengths, np.arange(L), side="right")
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
            for t in range(L) if d == 0 else range(L - 1, -1, -1):
                np.matmul(h, self.U[d], out=g)
                np.take(self.P[d], x[t], axis=1, out=q, mode="clip")
                g += q
                np.exp(g, out=g)
                g += 1
                np.divide(scale, g, out=g)
                z -= 0.5
                z *= i
                c *= f
                c += z
                np.exp(c, out=top)
                top += 1
                np.reciprocal(top, out=top)
                top -= 0.5
                np.multiply(o, top, out=h)
                if d and ended[t]:
                    h[: ended[t]] = 0
                    c[: ended[t]] = 0
                e[t] += np.matmul(self.W[d], h.T, out=out)

    def stepped(self, d: int, x: np.ndarray, lengths: np.ndarray, e: np.ndarray) -> None:
        """The same by onnxruntime; each step reads only the windows that have a character there, the last ones."""
        L, n = x.shape
        x = x.astype(np.int64)
        h = c = np.zeros((n if d == 0 else 0, self.hidden), np.float32)
        ended = np.searchsorted(lengths, np.arange(L), side="right")
        for t in range(L) if d == 0 else range(L - 1, -1, -1):
            live = n - ended[t]
            if live > len(h):
                begun = np.zeros((live - len(h), self.hidden), np.float32)
                h, c = np.concatenate([begun, h]), np.concatenate([begun, c])
            h, c, out = self.steps[d](x[t, ended[t] :], h[len(h) - live :], c[len(c) - live :])
            e[t, :, ended[t] :] += out

    def contested(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Windows in which some path may beat that of O alone: an upper bound in which all kinds share the best emission and transition.

        In the others no path can, whatever its kinds, so the full search is left to these.
        """
        L, _, n = e.shape
        above = np.stack([e[:, b::2].max(axis=1) for b in (1, 2)], axis=1) - e[:, :1]
        score = np.repeat(self.first[:, None], n, axis=1)
        score[1:] += above[0]
        out = np.empty(n, bool)
        every, into = np.empty((3, 3, n), np.float32), self.into[:, :, None]
        ended = np.searchsorted(lengths, np.arange(L + 1), side="right")
        for t in range(1, L + 1):
            done = slice(ended[t - 1], ended[t])
            if done.start < done.stop:
                out[done] = score[:, done].max(axis=0) > 0
            if t < L:
                np.add(into, score, out=every)
                np.maximum(every[:, 0], every[:, 1], out=score)
                np.maximum(score, every[:, 2], out=score)
                score[1:] += above[t]
        return np.flatnonzero(out)

    def scores(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best score of a path up to each character by its tag, and what the best path of each window scores above the path of O alone."""
        L, k, n = e.shape
        T = self.T[:, :, None]
        score = np.empty_like(e)
        score[0], only = self.S[:, None] + e[0], self.S[0] + e[0, 0]
        above = np.empty(n, np.float32)
        every = np.empty((k, k, n), np.float32)
        ended = np.searchsorted(lengths, np.arange(L + 1), side="right")
        for t in range(1, L + 1):
            done = slice(ended[t - 1], ended[t])
            if done.start < done.stop:
                above[done] = score[t - 1, :, done].max(axis=0) - only[done]
            if t < L:
                np.add(score[t - 1][:, None, :], T, out=every)
                every.max(axis=0, out=score[t])
                score[t] += e[t]
                only = only + (self.T[0, 0] + e[t, 0])
        return score, above

    def tags(self, windows: list[str]) -> list[np.ndarray]:
        """Best tag sequence of each window, none of them empty, sorted by length; only paths that beat O alone are traced back."""
        x, lengths = encode(windows)
        x = np.ascontiguousarray(x.T)
        e = np.empty((len(x), len(TAGS), len(windows)), np.float32)
        e[:] = self.b[:, None]
        self.direction(0, x, lengths, e)
        self.direction(1, x, lengths, e)
        out = [np.zeros(n, np.int8) for n in lengths]
        some = self.contested(e, lengths)
        if len(some):
            score, above = self.scores(e[:, :, some], lengths[some])
            some, score = some[above > 0], score[:, :, above > 0]
        if len(some):
            last, to = lengths[some] - 1, np.ascontiguousarray(self.T.T)
            path = np.zeros((len(x), len(some)), np.int8)
            tag = np.zeros(len(some), np.int64)
            for t in range(len(x) - 1, -1, -1):
                # the tag after t decides; at a window's last character there is none
                reached = score[t].T + np.where((t < last)[:, None], to[tag], 0)
                tag = reached.argmax(axis=1)
                path[t] = tag
            for r, k in enumerate(some):
                out[k] = path[: lengths[k], r].copy()
        return out


def tag_windows(p: dict[str, np.ndarray] | Decoder, windows: list[str], batch: int | None = None) -> list[np.ndarray]:
    """Tags of each window; windows of like length are decoded together, ``batch`` at a time."""
    decoder = p if isinstance(p, Decoder) else Decoder(p)
    batch = batch or (2048 if all(decoder.steps) else 1024)
    order = sorted((k for k, w in enumerate(windows) if w), key=lambda k: len(windows[k]))
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(windows)
    for at in range(0, len(order), batch):
        part = order[at : at + batch]
        if part:
            for k, tags in zip(part, decoder.tags([windows[k] for k in part])):
                out[k] = tags
    return out


def loss_and_gradients(p: dict, x: np.ndarray, lengths: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the CRF per window and its gradients."""
    n, L = x.shape
    hidden, k = p["U"].shape[1], len(TAGS)
    h, both, saved = lstm(p, x, lengths, keep=True)
    e = (h @ p["W"] + p["b"]).astype(np.float64)
    T, S = p["T"].astype(np.float64), p["S"].astype(np.float64)
    live = np.arange(L)[None, :] < lengths[:, None]

    eT = np.exp(T)

    def lse(a: np.ndarray) -> np.ndarray:
        m = a.max(axis=1, keepdims=True)
        return m[:, 0] + np.log(np.exp(a - m).sum(axis=1))

    def moved(a: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Log of exp(a) @ table by rows."""
        m = a.max(axis=1, keepdims=True)
        return m + np.log(np.exp(a - m) @ table)

    alpha = np.zeros((L, n, k))
    alpha[0] = S + e[:, 0]
    for t in range(1, L):
        alpha[t] = np.where(live[:, t, None], moved(alpha[t - 1], eT) + e[:, t], alpha[t - 1])
    logz = lse(alpha[-1])
    beta = np.zeros((L, n, k))
    gT, rows = np.zeros_like(T), np.arange(n)
    for t in range(L - 2, -1, -1):
        nxt = e[:, t + 1] + beta[t + 1]
        beta[t] = np.where(live[:, t + 1, None], moved(nxt, eT.T), 0.0)
        top = alpha[t].max(axis=1, keepdims=True)
        gT += (np.exp(alpha[t] - top).T @ (np.exp(nxt + top - logz[:, None]) * live[:, t + 1, None])) * eT
        np.add.at(gT, (gold[:, t], gold[:, t + 1]), -live[:, t + 1].astype(float))
    marginal = np.exp(alpha.transpose(1, 0, 2) + beta.transpose(1, 0, 2) - logz[:, None, None]) * live[:, :, None]
    score = S[gold[:, 0]] + (e[rows[:, None], np.arange(L)[None, :], gold] * live).sum(axis=1)
    score += (T[gold[:, :-1], gold[:, 1:]] * live[:, 1:]).sum(axis=1)
    ge = marginal
    ge[rows[:, None], np.arange(L)[None, :], gold] -= live
    ge = (ge / n).astype(np.float32)
    grads = {"S": ge[:, 0].sum(axis=0), "T": (gT / n).astype(np.float32), "b": ge.sum(axis=(0, 1)), "W": np.einsum("nlh,nlk->hk", h, ge)}
    gh = ge @ p["W"].T
    dirs = np.stack([gh[:, :, :hidden], _reverse(gh[:, :, hidden:], lengths)])
    gU = np.zeros_like(p["U"])
    into = np.empty((L, 2, n, 4 * hidden), np.float32)
    dh = np.zeros((2, n, hidden), np.float32)
    dc = np.zeros_like(dh)
    ut = p["U"].transpose(0, 2, 1)
    for t in range(L - 1, -1, -1):
        before_h, before_c, g, tc = saved[t]
        i, f, o, z = (g[:, :, q * hidden : (q + 1) * hidden] for q in range(4))
        dh = dh + dirs[:, :, t]
        dc = dc + dh * o * (1 - tc * tc)
        d = np.concatenate([dc * z * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - z * z)], axis=2)
        gU += np.matmul(before_h.transpose(0, 2, 1), d)
        into[t] = d
        dh = np.matmul(d, ut)
        dc = dc * f
    # one row of the table per class: sums by a product with the classes as unit vectors
    unit = np.eye(VOCABULARY, dtype=np.float32)
    gP = np.stack([unit[both[q].T.ravel()].T @ into[:, q].reshape(L * n, 4 * hidden) for q in range(2)])
    grads |= {"P": gP, "U": gU}
    return float((logz - score).mean()), grads


class Adam:
    def __init__(self, p: dict, rate: float):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.rate, self.t = rate, 0

    def step(self, p: dict, g: dict, rate: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k in p:
            x = g[k] * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            mh, vh = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            p[k] -= (rate * mh / (np.sqrt(vh) + 1e-8)).astype(p[k].dtype)


def fit(sample, steps: int, batch: int = 96, rate: float = 8e-3, seed: int = 5, start=None, say=None) -> dict[str, np.ndarray]:
    """Train on ``sample(n)``, which gives n pairs of window and tag array."""
    p = start or fresh(seed)
    adam = Adam(p, rate)
    for k in range(steps):
        rows = sample(batch)
        x, lengths = encode([w for w, _ in rows])
        gold = np.zeros(x.shape, np.int64)
        for r, (_, tags) in enumerate(rows):
            gold[r, : len(tags)] = tags
        loss, grads = loss_and_gradients(p, x, lengths, gold)
        adam.step(p, grads, rate * min(1.0, (k + 1) / 50) * (0.02 + 0.98 * (1 - k / steps)))
        if say and k % 50 == 0:
            say(k, loss)
    return p
