"""A small causal self-attention model over subword ids, in numpy.

One layer: a query attends to the tokens of its window up to itself, with a learned bias for each
distance; a layer with a rational tanh (``Scorer.state``) follows. As keys, queries and values depend on a token alone, they are rows of
three tables. The output has two steps: a class of tokens, then a member of the class. Tokens are
classed by their rank among the corpus's subwords, frequent ones in small classes, so that few members
are weighed for most tokens; those beyond the last class (of 4,096 ids together) share a tail whose
members have their smoothed corpus frequency. So probabilities over all ids add up to one.
"""

from __future__ import annotations

import numpy as np

#: Classes of each size, the most frequent ids first.
SIZES = [(16, 32), (64, 16), (160, 16)]
CLASSES, MEMBERS = sum(n for _, n in SIZES), max(m for m, _ in SIZES)
OF_CLASS = np.repeat([m for m, _ in SIZES], [n for _, n in SIZES])
FIRST = np.cumsum(OF_CLASS) - OF_CLASS
KNOWN = int(OF_CLASS.sum())
#: The class of each slot; the tail is a class of its own.
CLASS = np.append(np.repeat(np.arange(CLASSES), OF_CLASS), CLASSES)
#: Input rows beyond the known tokens: the tail, and the start of a text.
TAIL, START = KNOWN, KNOWN + 1
DIM, HIDDEN = 16, 32
#: Tokens of a window, and those that it scores: its last ones.
WINDOW, STRIDE = 32, 24

Weights = dict[str, np.ndarray]


class Ranks:
    """Ids to input rows and targets. counts: of each id in the corpus."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.slot = np.full(len(counts), TAIL, np.int32)
        self.slot[order[:KNOWN]] = np.arange(min(KNOWN, len(counts)), dtype=np.int32)
        tail = counts + 1.0
        tail[order[:KNOWN]] = 0
        self.tail_log = np.log(np.maximum(tail, 1e-300) / max(tail.sum(), 1e-300)).astype(np.float64)
        self.first_bias = counts[order[:KNOWN]] + 0.5
        self.tail_count = counts[order[KNOWN:]].sum() + 0.5


def first_weights(ranks: Ranks, seed: int = 4) -> Weights:
    rng = np.random.default_rng(seed)
    f = lambda *s: rng.normal(0, s[0] ** -0.5 if len(s) > 1 else 0, s).astype(np.float32)
    each = np.full(KNOWN, 0.5)
    each[: len(ranks.first_bias)] = np.maximum(ranks.first_bias, 0.5)
    # rows are as long as the largest class; what is beyond a class's size is never read
    by_class = np.ones((CLASSES, MEMBERS))
    by_class[np.arange(MEMBERS) < OF_CLASS[:, None]] = each
    return {
        "E": rng.normal(0, 0.3, (KNOWN + 2, DIM)).astype(np.float32), "Wq": f(DIM, DIM), "Wk": f(DIM, DIM), "Wv": f(DIM, DIM) * np.float32(0.5),
        "r": np.zeros(WINDOW, np.float32), "W1": f(DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "W2": f(HIDDEN, DIM) * np.float32(0.5),
        "C": f(DIM, CLASSES + 1) * np.float32(0.3), "bc": np.log(np.append(np.add.reduceat(each, FIRST), ranks.tail_count)).astype(np.float32),
        "M": (f(DIM, CLASSES * MEMBERS) * np.float32(0.3)).reshape(DIM, CLASSES, MEMBERS).transpose(1, 0, 2).copy(), "bm": np.log(by_class).astype(np.float32),
    }


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as slots, one after the other in rows of STRIDE with room for the context before: inputs, targets (-1: none), the first place of each window, the window's text."""
    room = WINDOW - STRIDE
    sizes = np.array([len(t) for t in texts])
    windows = -(-sizes // STRIDE)
    width = room + windows * STRIDE
    base = np.cumsum(width) - width
    inputs = np.full(int(width.sum()), -1, np.int32)
    targets = np.full(len(inputs), -1, np.int32)
    if not len(texts):
        return inputs, targets, base, base
    flat = np.concatenate(texts)
    at = np.repeat(base + room - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
    targets[at] = flat
    inputs[at[:-1] + 1] = flat[:-1]  # an input follows its target; the next line sets the first of each text
    inputs[(base + room)[sizes > 0]] = START
    # the place after a text's last token got an input that belongs to nothing
    after = base + room + sizes
    after = after[(after < len(inputs)) & (sizes > 0)]
    inputs[after[targets[after] < 0]] = -1
    text = np.repeat(np.arange(len(texts)), windows)
    starts = np.repeat(base - (np.cumsum(windows) - windows) * STRIDE, windows) + np.arange(int(windows.sum())) * STRIDE
    return inputs, targets, starts, text


_AHEAD = np.arange(STRIDE)[:, None] + WINDOW - STRIDE - np.arange(WINDOW)[None, :]


def _tables(w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return w["E"] @ w["Wq"] * np.float32(DIM**-0.5), w["E"] @ w["Wk"], w["E"] @ w["Wv"]


def _longest(a: np.ndarray) -> float:
    return float(np.sqrt(np.square(a, dtype=np.float64).sum(axis=-1).max()))


class Scorer:
    """A model's weights laid out for scoring: places without a token have a last row of their own in every table, and biases are a last column or row."""

    def __init__(self, w: Weights):
        q, k, v = _tables(w)
        none = np.zeros((1, DIM), np.float32)
        one = np.ones((len(q) + 1, 1), np.float32)
        apart = np.zeros((len(q) + 1, 1), np.float32)
        apart[-1] = -1e9
        self.q, self.k = np.hstack([np.vstack([q, none]), one]), np.hstack([np.vstack([k, none]), apart])
        # the values' last column adds up the weights
        self.v, self.e = np.hstack([np.vstack([v, none]), one]), np.vstack([w["E"], none])
        self.bias = np.where(_AHEAD >= 0, w["r"][np.maximum(_AHEAD, 0)], np.float32(-1e9)).astype(np.float32)
        self.inner, self.inner_bias, self.outer = w["W1"], w["b1"], w["W2"]
        self.by_class = np.concatenate([w["C"], w["bc"][None, :]])
        both = np.concatenate([w["M"], w["bm"][:, None, :]], axis=1)
        self.by_member = [np.ascontiguousarray(own[:, :m]).astype(np.float64) for own, m in zip(both, OF_CLASS.tolist())]
        # the weights alone bound the logits; where e to them could overflow, the largest is taken away first
        z = _longest(w["E"]) + _longest(v) + float(np.abs(w["W2"]).sum(axis=0).max()) * DIM**0.5
        self.calm = max(_longest(q) * _longest(k) + np.abs(w["r"]).max(), z * _longest(w["C"].T) + np.abs(w["bc"]).max(), z * _longest(w["M"].transpose(0, 2, 1)) + np.abs(w["bm"]).max()) < 80

    def context(self, x: np.ndarray) -> np.ndarray:
        """What the last STRIDE places of each window of inputs become."""
        own = x[:, -STRIDE:]
        a = np.matmul(np.take(self.q, own, axis=0, mode="wrap"), np.take(self.k, x, axis=0, mode="wrap").transpose(0, 2, 1))
        a += self.bias
        if not self.calm:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        summed = np.matmul(a, np.take(self.v, x, axis=0, mode="wrap"))
        h = summed[..., :DIM] / np.maximum(summed[..., DIM:], np.float32(1e-30))  # nobody asks for places that have nothing to attend to
        h += np.take(self.e, own, axis=0, mode="wrap")
        return h

    def state(self, h: np.ndarray) -> np.ndarray:
        t = np.matmul(h, self.inner)
        t += self.inner_bias
        np.clip(t, -3, 3, out=t)
        squares = t * t
        below = squares * np.float32(9)
        below += 27
        squares += 27
        t *= squares
        t /= below
        z = np.ones((*h.shape[:-1], DIM + 1), np.float32)
        np.add(np.matmul(t, self.outer), h, out=z[..., :DIM])
        return z

    def log_softmax_at(self, logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """logits are used up."""
        if not self.calm:
            logits -= logits.max(axis=1, keepdims=True)
        picked = np.take(logits.reshape(-1), at + np.arange(len(at)) * logits.shape[1])
        np.exp(logits, out=logits)
        return picked - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


#: Sums over rows are asked for in multiples of so many rows, so that none is a remainder, which is added up in another order.
ROWS = 64
#: Scores are rounded to so many digits after the point, below which the order of a sum may show.
DIGITS = 6


def score(w: Weights, texts: list[np.ndarray], at_once: int = 1024, part: int = 64) -> np.ndarray:
    """Log probability of each text's slots (natural logarithm, without tail members), in double precision.

    A text's score doesn't depend on what is scored beside it. Single-precision products are made
    window by window, where a token has the same place whatever the batch; what is weighed among other
    texts' tokens (the members of classes) is multiplied in double precision, and sums are rounded.
    """
    inputs, targets, starts, text = laid_out(texts)
    out = np.zeros(len(texts))
    if len(inputs) < WINDOW:
        return out
    model = Scorer(w)
    views = np.lib.stride_tricks.sliding_window_view(inputs, WINDOW)
    goals = np.lib.stride_tricks.sliding_window_view(targets, WINDOW)
    for k in range(0, len(starts), at_once):
        here = min(at_once, len(starts) - k)
        z = np.empty((-(-here // part) * part * STRIDE, DIM + 1), np.float32)
        target = np.full((len(z) // STRIDE, STRIDE), -1, np.int32)
        target[:here] = goals[starts[k : k + here], -STRIDE:]
        target = target.reshape(-1)
        live = np.flatnonzero(target >= 0)
        at = CLASS[np.maximum(target, 0)]
        log = np.empty(len(z))
        windows = np.empty((part, WINDOW), inputs.dtype)
        for m in range(0, here, part):
            own = starts[k + m : k + min(m + part, here)]
            windows[: len(own)] = views[own]
            windows[len(own) :] = -1
            rows = slice(m * STRIDE, (m + part) * STRIDE)
            z[rows] = (found := model.state(model.context(windows))).reshape(-1, DIM + 1)
            log[rows] = model.log_softmax_at(np.matmul(found, model.by_class).reshape(part * STRIDE, -1), at[rows])
        klass = at[live]
        order = np.argsort(klass.astype(np.int8), kind="stable")
        ends = [0, *np.cumsum(np.bincount(klass, minlength=CLASSES + 1)).tolist()]
        c = 0
        for members, classes in SIZES:
            rows = live[order[ends[c] : ends[c + classes]]]
            own = np.take(z, rows, axis=0).astype(np.float64)
            logits = np.empty((-(-len(own) // ROWS) * ROWS, members))
            logits[len(own) :] = 0
            for j in range(c, c + classes):
                a, b = ends[j] - ends[c], ends[j + 1] - ends[c]
                np.dot(own[a:b], model.by_member[j], out=logits[a:b])
            picked = np.zeros(len(logits), np.int64)
            picked[: len(own)] = target[rows] - FIRST[at[rows]]
            log[rows] += model.log_softmax_at(logits.astype(np.float32), picked)[: len(own)]
            c += classes
        out += np.bincount(text[k + live // STRIDE], weights=log[live], minlength=len(out))
    return np.round(out, DIGITS)


class _Flat:
    """Weights, or what belongs to each, one after the other in one array: only what is read of the classes' rows; biases are last rows. Its parts are views."""

    def __init__(self, dtype: np.dtype):
        shapes = [(KNOWN + 2, DIM), (DIM, 3 * DIM), (WINDOW,), (DIM + 1, HIDDEN), (HIDDEN, DIM), (DIM + 1, CLASSES + 1), *((n, DIM + 1, m) for m, n in SIZES)]
        ends = np.cumsum([int(np.prod(shape)) for shape in shapes]).tolist()
        self.all = np.zeros(ends[-1], dtype)
        self.e, self.qkv, self.r, self.inner, self.outer, self.by_class, *self.by_member = (x.reshape(shape) for x, shape in zip(np.split(self.all, ends[:-1]), shapes))

    def _pairs(self, w: Weights) -> list[tuple[np.ndarray, np.ndarray]]:
        """Parts and where each is in w."""
        out = [(self.e, w["E"]), (self.r, w["r"]), (self.inner[:DIM], w["W1"]), (self.inner[DIM], w["b1"]), (self.outer, w["W2"]), (self.by_class[:DIM], w["C"]), (self.by_class[DIM], w["bc"])]
        out += [(self.qkv[:, k * DIM : (k + 1) * DIM], w[name]) for k, name in enumerate(("Wq", "Wk", "Wv"))]
        c = 0
        for (m, n), own in zip(SIZES, self.by_member):
            out += [(own[:, :DIM], w["M"][c : c + n, :, :m]), (own[:, DIM], w["bm"][c : c + n, :m])]
            c += n
        return out

    @classmethod
    def of(cls, w: Weights) -> _Flat:
        found = cls(w["E"].dtype)
        for own, there in found._pairs(w):
            own[...] = there
        return found

    def put(self, w: Weights) -> Weights:
        for own, there in self._pairs(w):
            there[...] = own
        return w


#: Sums of e to so much neither overflow nor vanish in single precision.
CALM = 60.0
_SCALE = np.repeat([DIM**-0.5, 1.0, 1.0], DIM)
_CLASS8 = CLASS.astype(np.int8)  # sorted by radix


def _softmax_step(logits: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The gradient by the logits (which are used up) of the negative log probability of at, over n; the sum of that."""
    if max(logits.max(), -logits.min()) > CALM:
        logits -= logits.max(axis=1, keepdims=True)
    flat, at = logits.reshape(-1), at + np.arange(len(at)) * logits.shape[1]
    picked = flat[at]
    p = np.exp(logits, out=logits)
    s = p @ np.ones(p.shape[1], p.dtype)
    loss = float((np.log(s) - picked).sum())
    s *= n
    p *= np.divide(1, s, out=s)[:, None]
    flat[at] -= 1 / n
    return p, loss


def _descent(w: _Flat, g: _Flat, x: np.ndarray, target: np.ndarray) -> tuple[float, int]:
    """Fills g. The loss and the number of targets."""
    b, dtype = len(x), w.all.dtype
    scaled = w.qkv * _SCALE.astype(dtype)
    at = np.maximum(x, 0).reshape(-1)
    e = np.take(w.e, at, axis=0)
    qkv = np.matmul(e, scaled).reshape(b, WINDOW, 3 * DIM)
    q, k, v = qkv[:, -STRIDE:, :DIM], qkv[..., DIM : 2 * DIM], qkv[..., 2 * DIM :]
    # weights of attention are left as they are before they are divided by their sums; what they are multiplied by is divided instead
    a = np.matmul(q, k.transpose(0, 2, 1))
    calm = max(a.max(), -a.min()) + np.abs(w.r).max() < CALM
    a += np.where(_AHEAD >= 0, w.r[np.maximum(_AHEAD, 0)], dtype.type(-1e9))
    if (x < 0).any():
        a += np.where(x < 0, dtype.type(-1e9), dtype.type(0))[:, None, :]
    if not calm:
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    share = a.reshape(-1, WINDOW) @ np.ones(WINDOW, dtype)
    share = 1 / np.maximum(share, dtype.type(1e-30))  # places that have nothing to attend to have no target either
    seen = np.matmul(a, v).reshape(-1, DIM)
    seen *= share[:, None]
    # from here on in the order of classes
    flat = target.reshape(-1)
    live = np.flatnonzero(flat >= 0)
    n = max(1, len(live))
    klass = _CLASS8[flat[live]]
    order = np.argsort(klass, kind="stable")
    ends = [0, *np.cumsum(np.bincount(klass, minlength=CLASSES + 1)).tolist()]
    klass, order = klass[order], live[order]
    goal = flat[order]
    h, z = (np.ones((len(order), DIM + 1), dtype) for _ in range(2))
    h[:, :DIM] = (e.reshape(b, WINDOW, DIM)[:, -STRIDE:].reshape(-1, DIM) + seen)[order]
    # x (27 + x^2) / (27 + 9 x^2), which runs smoothly into -1 and 1 at -3 and 3
    t = h @ w.inner
    np.clip(t, -3, 3, out=t)
    squares = t * t
    below = squares + 3
    below *= 9
    slope = squares - 9
    squares += 27
    t *= squares
    t /= below
    slope /= below
    slope *= slope
    slope *= 9
    z[:, :DIM] = t @ w.outer
    z[:, :DIM] += h[:, :DIM]
    loss = 0.0
    if len(order):
        p, loss = _softmax_step(z @ w.by_class, klass, n)
        np.matmul(z.T, p, out=g.by_class)
        dz = p @ w.by_class[:DIM].T
    else:
        g.by_class[...] = 0
        dz = np.zeros((0, DIM), dtype)
    c = 0
    for (members, classes), own, grad in zip(SIZES, w.by_member, g.by_member):
        # products class by class, the softmax for all classes of a size
        start, end = ends[c], ends[c + classes]
        spans = [(j - c, ends[j], ends[j + 1]) for j in range(c, c + classes)]
        c += classes
        grad[...] = 0
        if start == end:
            continue
        logits = np.empty((end - start, members), dtype)
        for j, first, last in spans:
            if last > first:
                np.dot(z[first:last], own[j], out=logits[first - start : last - start])
        p, more = _softmax_step(logits, goal[start:end] - FIRST[klass[start:end]], n)
        loss += more
        back = np.empty((end - start, DIM), dtype)
        for j, first, last in spans:
            if last > first:
                part = p[first - start : last - start]
                np.dot(z[first:last].T, part, out=grad[j])
                np.dot(part, own[j, :DIM].T, out=back[first - start : last - start])
        dz[start:end] += back
    dt = dz @ w.outer.T
    dt *= slope
    np.matmul(t.T, dz, out=g.outer)
    np.matmul(h.T, dt, out=g.inner)
    dz += dt @ w.inner[:DIM].T
    dh = np.zeros((b * STRIDE, DIM), dtype)
    dh[order] = dz
    mean = np.einsum("ij,ij->i", dh, seen)
    mean *= share
    shared = (dh * share[:, None]).reshape(b, STRIDE, DIM)
    da = np.matmul(shared, v.transpose(0, 2, 1))
    da -= mean.reshape(b, STRIDE, 1)
    da *= a
    over = da.sum(axis=0)
    g.r[...] = np.bincount(np.maximum(_AHEAD, 0).reshape(-1), weights=np.where(_AHEAD >= 0, over, 0).reshape(-1), minlength=WINDOW)
    back = np.empty_like(qkv)
    back[:, :-STRIDE, :DIM] = 0
    np.matmul(da, k, out=back[:, -STRIDE:, :DIM])
    np.matmul(da.transpose(0, 2, 1), q, out=back[..., DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), shared, out=back[..., 2 * DIM :])
    back = back.reshape(-1, 3 * DIM)
    # q comes with its scale, k meets it in q
    np.matmul(e.T, back, out=g.qkv)
    g.qkv *= _SCALE.astype(dtype)
    each = back @ scaled.T
    each.reshape(b, WINDOW, DIM)[:, -STRIDE:] += dh.reshape(b, STRIDE, DIM)
    places = (at[:, None].astype(np.int64) * DIM + np.arange(DIM)).reshape(-1)
    g.e[...] = np.bincount(places, weights=each.reshape(-1), minlength=g.e.size).reshape(g.e.shape)
    return loss / n, len(live)


def gradients(w: Weights, x: np.ndarray, target: np.ndarray) -> tuple[Weights, float, int]:
    """Of the mean negative log probability of target (windows, STRIDE), -1 where there is none; that and the number of targets."""
    own = _Flat.of(w)
    g = _Flat(own.all.dtype)
    loss, n = _descent(own, g, x, target)
    return g.put({name: np.zeros_like(p) for name, p in w.items()}), loss, n


#: Weights that a step of ``trained`` changes at once, so that they and what belongs to them stay in a core's cache.
AT_HAND = 16_384


def trained(w: Weights, inputs: np.ndarray, targets: np.ndarray, tokens: int, rate: float, last_rate: float, seed: int, batch: int = 96) -> tuple[Weights, int]:
    """Adam over windows (inputs: WINDOW wide, targets: STRIDE wide) in random order, again and again until so many tokens have been seen. The new weights and the tokens seen."""
    w = {k: v.copy() for k, v in w.items()}
    if not len(inputs) or not (targets >= 0).any():
        return w, 0
    rng = np.random.default_rng(seed)
    own = _Flat.of(w)
    g, m, v = (_Flat(own.all.dtype) for _ in range(3))
    chunks = [[x.all[k : k + AT_HAND] for x in (own, g, m, v)] for k in range(0, len(own.all), AT_HAND)]
    seen = step = 0
    while seen < tokens:
        for some in np.array_split(rng.permutation(len(inputs)), -(-len(inputs) // batch)):
            seen += _descent(own, g, inputs[some], targets[some])[1]
            step += 1
            lr = last_rate + (rate - last_rate) * max(0.0, 1 - seen / tokens)
            # m is ten times the mean of gradients, v a hundred times that of squares
            root = (1 - 0.99**step) ** 0.5
            for here, grad, mean, square in chunks:
                mean *= 0.9
                mean += grad
                grad *= grad
                square *= 0.99
                square += grad
                np.sqrt(square, out=grad)
                grad += 1e-6 * root
                np.divide(mean, grad, out=grad)
                grad *= lr * root / (1 - 0.9**step)
                here -= grad
            if seen >= tokens:
                break
    return own.put(w), seen
