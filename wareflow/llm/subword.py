"""Supervised text classification by averaged subword embeddings.

A text's features are its words, its pairs of neighbouring words (a word next to itself is one feature, whichever
the word) and the character n-grams of its words, each hashed into a table of learned vectors.  N-grams are of code
points and lie within a word and the white space on either side of it, which stands for the word's bounds.  The mean of each kind's vectors,
averaged over the kinds, goes through a linear layer and a softmax.  Table and layer are trained in numpy by
stochastic gradient descent on a bounded sample of labelled rows; scoring runs over all rows.

Texts are read whole, in blocks of ``BLOCK`` characters cut at white space where there is some; no feature crosses
a cut.  A text without features has the mean vector zero, so its score is the bias alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from wareflow.llm.words import LOWER, SPACES, mix, span_hashes, spans

BLOCK = 1 << 20
KINDS = 4


@dataclass(frozen=True)
class Shape:
    """Of the feature table: ``buckets`` (a power of two) for each kind, vectors of ``dim`` numbers."""

    buckets: int = 1 << 16
    dim: int = 8
    grams: tuple[int, int] = (3, 4)
    lower: bool = True
    #: Whether a word next to itself is a feature: it tells of a text's quality, but not of its language.
    repeats: bool = True


def blocks(text: str):
    """Pieces of ``text`` that make it up, each at most BLOCK characters."""
    at = 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(" ", at, at + BLOCK), text.rfind("\n", at, at + BLOCK)) + 1
        cut = cut if cut > at else at + BLOCK
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def _grams(text: str, shape: Shape) -> list[np.ndarray]:
    """The bucket numbers of the character n-grams of each size."""
    wide = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if shape.lower:
        wide = np.where((wide >= 65) & (wide <= 90), wide + np.uint32(32), wide)
    space = (wide == 32) | (wide >= 9) & (wide <= 13)
    wide = np.where(space, np.uint32(32), wide)
    down, found = np.uint32(32 - (shape.buckets.bit_length() - 1)), []
    for n in shape.grams:
        count = max(0, len(wide) - n + 1)
        h, outside = np.zeros(count, np.uint32), np.zeros(count, bool)
        for k in range(n):
            h = (h + wide[k : k + count]) * np.uint32(0x01000193) ^ (h >> np.uint32(15))
            if 0 < k < n - 1:
                outside |= space[k : k + count]
        found.append(((h[~outside] * np.uint32(0x9E3779B1)) >> down).astype(np.int64))
    return found


def features(text: str | None, shape: Shape):
    """For each block of the text, the bucket numbers of each kind."""
    bits = np.uint64(64 - (shape.buckets.bit_length() - 1))
    for block in blocks(text or ""):
        letters = np.frombuffer(block.encode("utf-8", "surrogatepass"), np.uint8)
        if shape.lower:
            letters = LOWER[letters]
        words = span_hashes(letters, *spans(letters, SPACES))
        pairs = mix(words[:-1] * np.uint64(3) + words[1:])
        same = words[:-1] == words[1:]
        pairs[same] = np.uint64(0x9E3779B97F4A7C15)
        pairs = pairs if shape.repeats else pairs[~same]
        found = [(words >> bits).astype(np.int64), (pairs >> bits).astype(np.int64), *_grams(block, shape)]
        yield [kind * shape.buckets + f for kind, f in enumerate(found)]


def counted(text: str | None, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their weights in its vector."""
    kinds: list[list[np.ndarray]] = [[] for _ in range(KINDS)]
    for block in features(text, shape):
        for kind, f in enumerate(block):
            kinds[kind].append(f)
    ids, weights = [], []
    for parts in kinds:
        if parts and (total := sum(map(len, parts))):
            i, n = np.unique(np.concatenate(parts), return_counts=True)
            ids.append(i)
            weights.append(n / (total * KINDS))
    if not ids:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    return np.concatenate(ids).astype(np.int32), np.concatenate(weights).astype(np.float32)


@dataclass
class SubwordModel:
    shape: Shape
    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    classes: list = field(default_factory=list)
    #: Divides the scores before the softmax; fitted on rows that training did not see.
    temperature: float = 1.0
    #: Probabilities under this are rejected.
    reject_below: float = 0.0

    def vector(self, text: str | None) -> np.ndarray:
        sums, counts = np.zeros((KINDS, self.shape.dim)), np.zeros(KINDS)
        for block in features(text, self.shape):
            for kind, f in enumerate(block):
                if len(f):
                    sums[kind] += self.table.take(f, axis=0).sum(axis=0, dtype=np.float64)
                    counts[kind] += len(f)
        return (sums / np.maximum(counts, 1)[:, None]).sum(axis=0) / KINDS

    def probabilities(self, texts) -> np.ndarray:
        hidden = np.array([self.vector(t) for t in texts]).reshape(-1, self.shape.dim)
        return softmax((hidden @ self.layer + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: list, shape: Shape, epochs: int = 4, rate: float = 0.25, seed: int = 7) -> SubwordModel:
    """Stochastic gradient descent on the softmax loss, a row a step; rows are distinct buckets with weights.

    A bucket's step is scaled by its row's number of buckets, so that long texts move their vectors as far as
    short ones.  Classes weigh the same in the loss, whatever their share of the rows: rows of rare classes are taken
    several times an epoch rather than with a large step, which at most doubles the steps.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / shape.dim, 1 / shape.dim, (KINDS * shape.buckets, shape.dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (shape.dim, len(classes))).astype(np.float32)
    bias = np.zeros(len(classes), np.float32)
    share = np.bincount(labels, minlength=len(classes)) / max(1, len(labels))
    weight = np.where(share > 0, 1 / np.maximum(share * np.count_nonzero(share), 1e-9), 0)
    times = np.maximum(1, np.rint(weight)).astype(np.int64)
    weight = weight / times
    taken = np.repeat(np.arange(len(rows)), times[labels])
    steps, done = max(1, epochs * len(taken)), 0
    for _ in range(epochs):
        for i in rng.permutation(taken):
            ids, w = rows[i]
            vectors = table[ids]
            hidden = w @ vectors if len(ids) else np.zeros(shape.dim, np.float32)
            scores = hidden @ layer + bias
            e = np.exp(scores - scores.max())
            grad = (e / e.sum()).astype(np.float32)
            grad[labels[i]] -= 1
            lr = np.float32((rate * (1 - done / steps) + 1e-3) * weight[labels[i]])
            grad *= lr
            back = layer @ grad
            layer -= np.outer(hidden, grad)
            bias -= grad
            table[ids] = vectors - (w * np.float32(len(ids)))[:, None] * back
            done += 1
    # Undo the even weights: the bias then stands for the classes' shares in the sample.
    bias = bias + np.log(np.maximum(share, 1e-9)).astype(np.float32) - np.log(1 / max(1, np.count_nonzero(share)))
    return SubwordModel(shape, table, layer, bias.astype(np.float32), classes)


def calibrate(model: SubwordModel, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, precision: float = 0.99) -> SubwordModel:
    """Sets the temperature that makes held-back rows likeliest, and the probability under which to reject.

    The rejection level is the lowest at which the rows at or above it are right ``precision`` of the time.
    """
    if not len(rows):
        return model
    hidden = np.array([(model.table[i] * w[:, None]).sum(axis=0) if len(i) else np.zeros(model.shape.dim) for i, w in rows])
    scores = hidden @ model.layer + model.bias
    levels = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in levels]
    model.temperature = float(levels[int(np.argmin(loss))])
    p = softmax(scores / model.temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision)
    model.reject_below = float(best[order[good[-1]]]) if len(good) else 1.0
    return model
