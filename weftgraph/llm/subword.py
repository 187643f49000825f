"""Averaged hashed subword embeddings with a softmax on top, trained by stochastic gradient descent in numpy.

A text is a bag of words; a word stands for its own hash bucket and those of
its character n-grams, marked at both ends. The text's vector is the mean of
the buckets' learned vectors, and a linear softmax gives class probabilities.
As nothing but a mean lies between the two, scoring needs only the product of
both tables, one row of class scores a bucket; a word's sum of rows is kept in a
bounded cache of the Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from itertools import islice
from operator import eq

import numpy as np

#: Words kept in a worker's cache; longer words than LONGEST_CACHED are scored each time.
CACHE_ENTRIES = 400_000
LONGEST_CACHED = 48
#: Characters of words hashed at once.
BLOCK_CHARS = 1 << 20
#: Stands for a word that repeats the one before; no text's word holds white space.
AGAIN = " again "


@dataclass(frozen=True)
class Shape:
    """What a text is turned into: bucket bits, n-gram lengths, whether case counts.

    `repeats` adds a word of its own for each word that equals the one before.
    `prior` is a number of empty features that every text is given, so that the
    mean over a few words stays near the classes' shares.
    """

    bits: int = 16
    shortest: int = 2
    longest: int = 4
    lower: bool = True
    repeats: bool = False
    prior: int = 0

    def words(self, text: str) -> list[str]:
        words = (text.lower() if self.lower else text).split()
        return words + [AGAIN] * sum(map(eq, words, islice(words, 1, None))) if self.repeats else words


def word_features(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, in the words' order, and the number of each word's buckets (at least one)."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(len(chars))  # characters to the word's end, this one included
    owner = np.repeat(np.arange(len(words)), length)
    prime, mix = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    found, owners = [], []
    rolled = np.zeros(len(chars), np.uint64)
    for n in range(1, shape.longest + 1):
        m = len(chars) - n + 1
        if m <= 0:
            break
        rolled = rolled[:m] * prime + chars[n - 1 :] + np.uint64(1)
        if n >= shape.shortest:
            inside = left[:m] >= n
            found.append((rolled[inside] ^ np.uint64(n)) * mix >> np.uint64(64 - shape.bits))
            owners.append(owner[:m][inside])
    # The whole word: a sum of its characters, each weighted by a power of its distance to the end.
    powers = prime ** np.minimum(left, 1 << 20).astype(np.uint64)
    whole = np.add.reduceat(chars * powers, ends - length)
    found.append((whole ^ np.uint64(99)) * mix >> np.uint64(64 - shape.bits))
    owners.append(np.arange(len(words)))
    bucket, at = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return bucket[order], np.bincount(at, minlength=len(words))


def blocks(words: list[str]) -> Iterable[list[str]]:
    part, chars = [], 0
    for w in words:
        part.append(w)
        chars += len(w) + 2
        if chars >= BLOCK_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def bag(text: str, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and their shares of all its features."""
    total = np.zeros(1 << shape.bits, np.int64)
    for part in blocks(shape.words(text)):
        total += np.bincount(word_features(part, shape)[0], minlength=len(total))
    at = np.flatnonzero(total)
    return at.astype(np.uint16 if shape.bits <= 16 else np.uint32), (total[at] / max(1, total.sum() + shape.prior)).astype(np.float32)


@dataclass
class Model:
    """Class scores by bucket, biases, the temperature of the softmax, and the least score not to be rejected."""

    shape: Shape
    classes: list
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    sums: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "sums": None}

    def fresh(self) -> Model:
        """The same model with a cache of its own: a broadcast model outlives the task, and what it cached would lie beside the next task's."""
        return replace(self, cache={}, sums=None)

    def logits(self, texts: list[str]) -> np.ndarray:
        """Scaled class scores of whole texts; an empty text has the biases alone."""
        width = len(self.classes) + 1
        if self.sums is None:
            self.sums = np.zeros((1024, width))
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        split = [self.shape.words(t) for t in texts]
        missing = list(set().union(*split) - self.cache.keys())
        if len(self.cache) + len(missing) > len(self.sums):
            grown = np.zeros(((len(self.cache) + len(missing)) * 5 // 4, width))
            grown[: len(self.cache)] = self.sums[: len(self.cache)]
            self.sums = grown
        known, at = self.cache, len(self.cache)
        for part in blocks(missing):
            bucket, n = word_features(part, self.shape)
            into = self.sums[at : at + len(part)]
            into[:, :-1] = np.add.reduceat(self.scores[bucket], np.cumsum(n) - n)
            into[:, -1] = n
            known.update(zip(part, range(at, at + len(part)), strict=True))
            at += len(part)
        out = np.zeros((len(texts), width))
        for i, words in enumerate(split):
            if words:
                out[i] = self.sums[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
        if len(known) > CACHE_ENTRIES or missing and max(map(len, missing)) > 64 * LONGEST_CACHED:
            known.clear()
        return (out[:, :-1] / np.maximum(out[:, -1:] + self.shape.prior, 1) + self.bias) / self.temperature

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list, shape: Shape, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 7, validation: float = 0.15, rejected: float = 0.001) -> Model:
    """Fit a model to bags of buckets by plain stochastic gradient descent with a falling rate.

    The last share of the shuffled rows is held back to fit the temperature and
    to find the score under which `rejected` of its rows fall. Without rows, a
    model of no classes comes back.
    """
    classes = sorted(set(labels))
    size = 1 << shape.bits
    if not classes:
        return Model(shape, [], np.zeros((size, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    target = np.array([classes.index(y) for y in labels])
    table = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dim, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32)
    share = np.bincount(target, minlength=len(classes))
    weight = (share.mean() / share).clip(0.3, 3.0)  # rare classes count as much as frequent ones
    order = rng.permutation(len(bags))
    held = order[: int(validation * len(bags))] if len(bags) >= 50 else order[:0]
    learn = order[len(held) :]
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            at, w = bags[i]
            hidden = w @ table[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            p *= weight[target[i]]
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * np.float32(0.05) * p
            # Shares are small, so that a text's step on its buckets is scaled up by their number's root.
            table[at] -= (lr * np.sqrt(np.float32(len(at)))) * np.outer(w, back)
    model = Model(shape, classes, (table @ out).astype(np.float64), bias.astype(np.float64) - np.log(weight))  # back to the classes' own shares
    if len(held) and len(classes) > 1:
        z = np.stack([bags[i][1] @ model.scores[bags[i][0]] for i in held]) + model.bias
        def loss(t: float) -> float:
            return -np.log(softmax(z / t)[np.arange(len(held)), target[held]].clip(1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
        best = softmax(z / model.temperature).max(axis=1)
        model.reject_below = float(min(0.5, np.quantile(best, rejected)))
    return model
