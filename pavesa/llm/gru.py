"""A gated recurrent network over words in numpy: windows with carried state, truncated backpropagation over pieces of texts, class-factored softmax.

Word ids are in order of frequency, so a class is a range of ids. Id K stands for every rarer word (a class of its own, with nothing to choose
inside), K + 1 for the start of a text.

Numpy is fast on long contiguous lines only. So gates are blocks of their own, logits of all classes share a line, and sums and steps of the
weights go in layers and stretches.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

HIDDEN = 24
CLASSES = 64
LANES = 256
STEPS = 16
PADDING = 4
PIECE = 256
RATE = 0.08
SAFE = 80
LAYERS = 12
STRETCH = 8192


@dataclass
class Shape:
    """Sizes of a model: words, bounds of the classes (of ids), and units."""

    words: int
    bounds: np.ndarray
    hidden: int = HIDDEN

    @property
    def classes(self) -> int:
        return len(self.bounds) - 1

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, k = self.hidden, self.words
        return {"win": (k + 2, 3 * h), "u": (h, 3 * h), "wc": (h, self.classes + 1), "bc": (self.classes + 1,), "ww": (k, h), "bw": (k,)}

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, size in self.parts().items():
            n = int(np.prod(size))
            out[name] = flat[at : at + n].reshape(size)
            at += n
        return out


def shape_of(counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES) -> Shape:
    """Classes of about equal sums of square roots of counts (counts in falling order)."""
    mass = np.cumsum(np.sqrt(counts))
    number = np.minimum((classes * (mass - np.sqrt(counts) / 2) / mass[-1]).astype(int), classes - 1) if len(counts) else np.zeros(0, int)
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    return Shape(len(counts), np.append(starts, len(counts)).astype(np.int64), hidden)


def start(shape: Shape, counts: np.ndarray, rest: float) -> np.ndarray:
    """First weights: biases are the logs of the counts, so that the untrained model is the unigram model."""
    rng = np.random.default_rng(5)
    flat = np.zeros(sum(int(np.prod(s)) for s in shape.parts().values()), np.float32)
    p = shape.split(flat)
    p["win"][:] = rng.normal(0, 0.1, p["win"].shape)
    p["u"][:] = rng.normal(0, shape.hidden**-0.5, p["u"].shape)
    mass = np.add.reduceat(counts, shape.bounds[:-1]) if len(counts) else np.zeros(0)
    p["bc"][:] = np.log(np.append(mass, max(rest, 1)))
    p["bw"][:] = np.log(np.maximum(counts, 1))
    return flat


def lanes(texts: list[np.ndarray], width: int, order: Iterable[int] | None = None) -> list[list[int]]:
    """Texts (their numbers) dealt to at most ``width`` lanes of about equal length in the given order (None: longest first), the longest lane first."""
    out: list[list[int]] = [[] for _ in range(min(width, len(texts)))]
    load = np.zeros(len(out), np.int64)
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])) if order is None else order:
        j = int(load.argmin())
        out[j].append(i)
        load[j] += len(texts[i])
    return [out[j] for j in np.argsort(-load, kind="stable")]


@dataclass
class Batch:
    """Lanes as columns: word to read, word to predict, whether a text starts, and the text (-1: nothing)."""

    read: np.ndarray
    target: np.ndarray
    begins: np.ndarray
    owner: np.ndarray


def batch_of(texts: list[np.ndarray], first: int, width: int = LANES) -> Batch:
    """Texts in lanes; fewer lanes beside a long text, so that the columns hold some PADDING places for each word at most."""
    longest = max(map(len, texts), default=0)
    width = min(width, max(1, PADDING * sum(map(len, texts)) // max(1, longest)))
    return _columns(texts, [first] * len(texts), lanes(texts, width))


def lesson_of(texts: list[np.ndarray], first: int, width: int = LANES) -> Batch:
    """Texts for training, cut into pieces of PIECE words that lie in lanes in random order. So one long text never has a step to itself, and
    each step sees many texts. A piece begins with an empty state, but reads the word before it."""
    pieces = [(t[i : i + PIECE], t[i - 1] if i else first) for t in texts for i in range(0, len(t), PIECE)]
    parts = [p for p, _ in pieces]
    return _columns(parts, [b for _, b in pieces], lanes(parts, width, np.random.default_rng(len(parts)).permutation(len(parts)).tolist()))


def _columns(texts: list[np.ndarray], before: list[int], dealt: list[list[int]]) -> Batch:
    """Lanes of texts as columns; ``before`` is what each text reads first."""
    first = before[0] if before else 0
    length = max((sum(len(texts[i]) for i in lane) for lane in dealt), default=0)
    read, target = np.full((length, len(dealt)), first, np.int32), np.zeros((length, len(dealt)), np.int32)
    begins, owner = np.zeros((length, len(dealt)), bool), np.full((length, len(dealt)), -1, np.int32)
    for j, lane in enumerate(dealt):
        at = 0
        for i in lane:
            n = len(texts[i])
            target[at : at + n, j], owner[at : at + n, j] = texts[i], i
            read[at, j], read[at + 1 : at + n, j] = before[i], texts[i][:-1]
            begins[at, j] = True
            at += n
    return Batch(read, target, begins, owner)


def _blocks(weights: np.ndarray, size: int) -> np.ndarray:
    """Weights of the gates side by side as one contiguous block for each gate, so that no operation on a gate walks over short strided rows."""
    return np.ascontiguousarray(weights.reshape(len(weights), 3, size).transpose(1, 0, 2))


def _rows(blocks: np.ndarray) -> np.ndarray:
    """The gates side by side again."""
    return blocks.transpose(1, 0, 2).reshape(blocks.shape[1], -1)


def _joined(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes and of the words with their biases: the states get a column of ones, which the biases meet."""
    return np.vstack([p["wc"], p["bc"]]), np.column_stack([p["ww"], p["bw"]])


@dataclass
class Kept:
    """What going back through a window needs: states before each step, both gates, candidates and their recurrent part."""

    before: np.ndarray
    gates: np.ndarray
    n: np.ndarray
    own: np.ndarray


def _signed(blocks: np.ndarray) -> np.ndarray:
    """Weights for the exponentials of the gates: sigmoid(x) = 1 / (1 + exp(-x)), tanh(x) = 1 - 2 / (1 + exp(2x))."""
    return blocks * np.array([-1, -1, 2], blocks.dtype).reshape(3, *[1] * (blocks.ndim - 1))


def _steps(given: np.ndarray, u: np.ndarray, begins: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, Kept]:
    """States after each step of a window, and what going back needs (``keep``; else of the last step only). ``given``: what the words add to
    the gates. It and ``u`` are signed blocks."""
    room = len(begins) if keep else 1
    before, n = np.empty((2, room, *h.shape), u.dtype)
    gates, own = np.empty((room, 2, *h.shape), u.dtype), np.empty((room, 3, *h.shape), u.dtype)
    out = np.empty((len(begins), *h.shape), u.dtype)
    some = begins.any(1).tolist()
    with np.errstate(over="ignore"):  # a gate at its end
        for t in range(len(begins)):
            k = t if keep else 0
            was, both, new, of = before[k], gates[k], n[k], own[k]
            was[:] = h
            if some[t]:
                was[begins[t]] = 0
            np.matmul(was, u, out=of)
            np.add(of[:2], given[:2, t], out=both)
            np.exp(both, out=both)
            both += 1
            np.divide(1, both, out=both)
            np.multiply(both[1], of[2], out=new)
            new += given[2, t]
            np.exp(new, out=new)
            new += 1
            np.divide(2, new, out=new)
            np.subtract(1, new, out=new)
            h = out[t]
            np.subtract(was, new, out=h)
            h *= both[0]
            h += new
    return out, Kept(before, gates, n, own[:, 2] * u.dtype.type(0.5))


def _powers(logits: np.ndarray) -> bool:
    """Whether logits may be raised without taking off the peak of each target first; sums of some thousand of them stay finite then."""
    return bool(-SAFE < logits.min() and logits.max() < SAFE)


def _predict(shape: Shape, wc: np.ndarray, ww: np.ndarray, h: np.ndarray, target: np.ndarray, real: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The real places of a window, class by class, the natural log-probability of each one's target (class, then word in the class) and the gradient by h.
    Fills ``grad``. Weights come joined with biases.

    Logits by class are a row for each class. Those within classes lie in one line, class by class and target by target, so that the softmax of
    all classes is a few operations."""
    learn = grad is not None
    size = shape.hidden
    wide = np.append(np.diff(shape.bounds), 0)  # nothing to choose among the rarer words
    places = np.flatnonzero(real)
    target = target.ravel()[places]
    kind = np.repeat(np.arange(shape.classes + 1, dtype=np.int16), np.append(wide[:-1], 1))[target]
    order = np.argsort(kind, kind="stable")  # rows of a class side by side
    places, target, kind = places[order], target[order], kind[order]
    one = np.empty((len(order), size + 1), h.dtype)
    one[:, :size], one[:, size] = h.reshape(-1, size).take(places, 0), 1

    logits = wc.T @ one.T
    if not _powers(logits):
        logits -= logits.max(0)
    at = np.arange(len(order))
    value = logits[kind, at]
    np.exp(logits, out=logits)
    total = logits.sum(0)
    value -= np.log(total)
    back = None
    if learn:
        logits *= -1 / total
        logits[kind, at] += 1
        grad["wc"], grad["ww"] = (logits @ one).T, np.zeros_like(ww)
        back = logits.T @ wc[:size].T

    chosen = np.flatnonzero(wide[kind] > 1)
    if len(chosen):
        kind, target, one = kind[chosen], target[chosen], one.take(chosen, 0)
        length = wide[kind]
        starts = np.cumsum(length) - length
        line = np.empty(starts[-1] + length[-1], h.dtype)
        edges = np.flatnonzero(np.diff(kind, prepend=-1, append=shape.classes + 1))
        parts = []
        for i, end, c, start in zip(edges[:-1].tolist(), edges[1:].tolist(), kind[edges[:-1]].tolist(), starts[edges[:-1]].tolist(), strict=True):
            words, rows = slice(shape.bounds[c], shape.bounds[c + 1]), slice(i, end)
            logits = line[start : start + (end - i) * wide[c]].reshape(end - i, wide[c])
            np.matmul(one[rows], ww[words].T, out=logits)
            parts.append((rows, words, logits))
        if not _powers(line):
            line -= np.repeat(np.maximum.reduceat(line, starts), length)
        at = starts + target - shape.bounds[kind]
        picked = line[at]
        np.exp(line, out=line)
        total = np.add.reduceat(line, starts)
        value[chosen] += picked - np.log(total)
        if learn:
            line *= np.repeat(-1 / total, length)
            line[at] += 1
            within = np.empty_like(one)
            for rows, words, d in parts:
                np.matmul(d.T, one[rows], out=grad["ww"][words])
                np.matmul(d, ww[words], out=within[rows])
            back[chosen] += within[:, :size]
    return places, value, back


def score(shape: Shape, flat: np.ndarray, texts: list[np.ndarray], width: int = LANES, steps: int = 4 * STEPS) -> np.ndarray:
    """log10 probability of each whole text; the state is carried from window to window."""
    p = shape.split(flat)
    win, u = (_signed(_blocks(p[k], shape.hidden)) for k in ("win", "u"))
    wc, ww = _joined(p)
    b = batch_of(texts, shape.words + 1, width)
    out = np.zeros(len(texts))
    h = np.zeros((b.read.shape[1], shape.hidden), flat.dtype)
    for at in range(0, len(b.read), steps):
        active = int((b.owner[at] >= 0).sum())
        h = h[:active]
        part = slice(at, at + steps), slice(0, active)
        states, _ = _steps(win.take(b.read[part], 1), u, b.begins[part], h, False)
        h = states[-1]
        real = b.owner[part] >= 0
        places, value, _ = _predict(shape, wc, ww, states, b.target[part], real)
        out += np.bincount(b.owner[part].ravel()[places], value, len(texts))
    return out / np.log(10)


def _climb(weights: np.ndarray, sums: np.ndarray, g: np.ndarray, scale: np.float32, rate: float) -> None:
    """A step along a gradient, by the squares of it and of those before, in stretches that stay in the processor's caches. ``g`` is used up."""
    weights, sums, g = weights.reshape(-1), sums.reshape(-1), g.reshape(-1)
    room = np.empty(min(STRETCH, len(g)), g.dtype)
    for at in range(0, len(g), STRETCH):
        w, q, d = (x[at : at + STRETCH] for x in (weights, sums, g))
        work = room[: len(d)]
        d *= scale
        np.clip(d, -1, 1, out=d)
        np.multiply(d, d, out=work)
        q += work
        np.add(q, 1e-3, out=work)
        np.sqrt(work, out=work)
        d *= rate
        d /= work
        w += d


def _by_word(read: np.ndarray, gates: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words that a window reads, and for each the sum of its gradients (``gates``: by place). The first places of all words are added
    layer by layer, the words that occur most coming first; what frequent words have beyond LAYERS places is added word by word."""
    order = np.argsort(read, kind="stable")
    edges = np.flatnonzero(np.diff(read[order], prepend=-1))
    many = np.diff(edges, append=len(read))
    by = np.argsort(-many, kind="stable")
    edges, many = edges[by], many[by]
    layers = [order[edges]]
    layers += [order[edges[: int(np.searchsorted(-many, -k))] + k] for k in range(1, min(LAYERS, int(many[0])))]
    beyond = [order[a + LAYERS : a + n] for a, n in zip(edges.tolist(), many[: int(np.searchsorted(-many, -LAYERS))].tolist(), strict=False)]
    sums = np.empty((3, len(edges), gates[0].shape[1]), gates[0].dtype)
    for own, gate in zip(sums, gates, strict=True):
        own[:] = gate.take(layers[0], 0)
        for places in layers[1:]:
            own[: len(places)] += gate.take(places, 0)
        for i, places in enumerate(beyond):
            own[i] += gate.take(places, 0).sum(0)
    return read[layers[0]], sums


def _back(u: np.ndarray, begins: np.ndarray, kept: Kept, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the recurrent part of the gates, as blocks, and by what the words add to the candidates (to both gates: the same). ``outer``: by the states."""
    inner, last = np.empty((3, *outer.shape), outer.dtype), np.empty_like(outer)
    over = np.ascontiguousarray(u.transpose(0, 2, 1))
    some = begins.any(1).tolist()
    dh = np.zeros_like(outer[0])
    for t in range(len(outer) - 1, -1, -1):
        n, own = kept.n[t], kept.own[t]
        z, r = kept.gates[t]
        (dz, dr, di), dn = inner[:, t], last[t]
        dh += outer[t]
        rest = 1 - z
        np.multiply(dh, rest, out=dn)
        work = n * n
        np.subtract(1, work, out=work)
        dn *= work
        np.subtract(kept.before[t], n, out=dz)
        dz *= dh
        dz *= z
        dz *= rest
        np.multiply(dn, own, out=dr)
        dr *= r
        np.subtract(1, r, out=work)
        dr *= work
        np.multiply(dn, r, out=di)
        dh *= z
        for part in np.matmul(inner[:, t], over):
            dh += part
        if some[t]:
            dh[begins[t]] = 0
    return inner, last


def train(shape: Shape, flat: np.ndarray, texts: list[np.ndarray], squares: np.ndarray, rate: float = RATE) -> int:
    """One pass over some texts: weights and the sums of squared gradients change in place. Returns the number of words."""
    p, sums = shape.split(flat), shape.split(squares)
    b = lesson_of(texts, shape.words + 1)
    size = shape.hidden
    (win, u), (win_sums, u_sums) = ([_blocks(x[k], size) for k in ("win", "u")] for x in (p, sums))
    (wc, ww), (wc_sums, ww_sums) = _joined(p), _joined(sums)
    h = np.zeros((b.read.shape[1], size), flat.dtype)
    for at in range(0, len(b.read), STEPS):
        active = int((b.owner[at] >= 0).sum())
        h = h[:active]
        part = slice(at, at + STEPS), slice(0, active)
        read, begins = b.read[part], b.begins[part]
        states, kept = _steps(_signed(win.take(read, 1)), _signed(u), begins, h, True)
        real = b.owner[part] >= 0
        grad: dict[str, np.ndarray] = {}
        places, _, back = _predict(shape, wc, ww, states, b.target[part], real, grad)
        outer = np.zeros_like(states)
        outer.reshape(-1, size)[places] = back
        inner, last = _back(u, begins, kept, outer)
        scale = np.float32(1 / max(1, len(places)) ** 0.5)
        seen, change = _by_word(read.ravel(), [x.reshape(-1, size) for x in (inner[0], inner[1], last)])
        _climb(wc, wc_sums, np.ascontiguousarray(grad["wc"]), scale, rate)
        _climb(ww, ww_sums, grad["ww"], scale, rate)
        _climb(u, u_sums, np.matmul(kept.before.reshape(-1, size).T, inner.reshape(3, -1, size)), scale, rate)
        own, own_sums = win.take(seen, 1), win_sums.take(seen, 1)
        _climb(own, own_sums, change, scale, rate)
        win[:, seen], win_sums[:, seen] = own, own_sums
        h = states[-1]
    for x, blocks, joined in ((p, (win, u), (wc, ww)), (sums, (win_sums, u_sums), (wc_sums, ww_sums))):
        x["win"][:], x["u"][:] = map(_rows, blocks)
        x["wc"][:], x["bc"][:] = joined[0][:size], joined[0][size]
        x["ww"][:], x["bw"][:] = joined[1][:, :size], joined[1][:, size]
    return int((b.owner >= 0).sum())
