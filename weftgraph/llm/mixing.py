"""Language-model scores by logistic mixing of hashed-context bit predictors, beside a unigram base.

Model. A text is its words, lower-cased, each followed by a space, and an end
mark. Every bit of every byte is predicted from hashed contexts: the last one to
four bytes, and the word's whole beginning where that begins a frequent word, all
but the longest within the text's class. A word's first byte has the last bytes
of the word before it as contexts. The class is one of CLASSES, whose words and
shares are counted over all training texts, from a start by clustering a sample;
it is sent first, at the cost of its share.
Predictions are mixed in the logistic domain by weights that a gate (how far into
the word, and how much the longest context has seen) selects, and the result is
refined by an adaptive probability map. Weights and map learn online, over all
training text: each task predicts its text from what it has counted so far, then
counts it; the tasks' weights are averaged by what they have seen. Context counts
are summed over all tasks. Equal situations (contexts and byte) are computed once.

Beside that, a model of repeats covers whole passages. Texts are cut into
chunks at content-defined places, about CHUNK words each. A chunk may be drawn
from all chunks of other training texts, or of the text so far, by its frequency
there; the probability of such a draw is mixed, online along each text, from an
adaptive map of the last two chunks' fates and the text's own rate. A training
text's own chunks are not counted as others'.

Counting. Context tables have a fixed size. Words beyond a dense list and chunks
are counted exactly, however many there are: each slice of texts sends its
distinct ones, with their counts, to a bucket by hash, and gets the corpus counts
back. A word or chunk that is in a third of all texts comes once a slice, so no
key is hot. The base score is exact.

Null and empty texts are the end mark alone. A null id is held out. Without
training texts all counts are 0, and the base is 0. Repeated rows give repeated
results, an empty table an empty one, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, persisted, released, shuffle_width, slices, table, to_arrow_schema

#: Predictors: orders of byte contexts, then the frequent words' beginnings.
ORDERS = (1, 2, 3, 4)
INPUTS = len(ORDERS) + 1
TABLE_BITS = 22
BLOCK_BITS = 16
TRIE_BITS = 23
#: Words counted densely: the most frequent ones of all training texts.
FREQUENT = 65_536
#: Bits of the number by which texts are drawn.
DRAW_BITS = 42
#: Classes of texts, words whose counts tell them apart, rounds of clustering, sampled texts that these start from, and words of each; one more round goes over all training texts.
CLASSES, TELLING, ROUNDS, CLASS_TEXTS, CLASS_WORDS = 8, 1500, 15, 1800, 300
#: Mean words of a chunk.
CHUNK = 16
#: Items that a bucket counts at once.
BUCKET_ITEMS = 2_000_000
#: Distinct words held before a task adds them to its counts; words whose cost a worker keeps; bytes of words learned from or scored at once, and whose contexts are found at once.
HELD_WORDS = 200_000
CACHE_ENTRIES = 200_000
BATCH_BYTES = 1_000_000
PIECE_BYTES = 100_000
GATES, STEPS = 32, 33
#: Steps of online learning: situations a step, rates of weights and map.
STEP, RATE, MAP_RATE = 4096, 0.05, 0.3
#: Tables of so many tasks are summed at once; more tasks make more levels.
FAN_IN = 64
END = b"\n"  # no word holds it

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


class Tokens:
    """The words of many texts, numbered: distinct words, and for each running word its text and number."""

    def __init__(self, texts: list[str | None]):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
        self.texts, parts = len(texts), np.diff(lists.offsets.to_numpy())
        flat, lists = lists.flatten().dictionary_encode(), None
        names, flat = flat.dictionary.cast(pa.large_binary()), flat.indices
        self.word, flat = flat.to_numpy().astype(np.int64), None
        self.text = np.repeat(np.arange(len(texts)), parts)
        self.distinct: list[bytes] = names.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
        # The first byte of each distinct word and its last two (0 where it has none).
        _, offsets, data = names.buffers()
        at = np.frombuffer(offsets, np.int64, len(names) + 1, 8 * names.offset) + 2 if len(names) else np.full(1, 2)
        padded = np.r_[np.zeros(2, np.uint8), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), np.zeros(1, np.uint8)].astype(np.int64)
        length = np.diff(at)
        self.ends = np.stack([np.where(length > 0, padded[at[:-1]], 0), np.where(length > 1, padded[at[1:] - 2], 0), np.where(length > 0, padded[at[1:] - 1], 0)], axis=1)
        if b"" in self.distinct:  # from white space at a text's ends
            keep = self.word != self.distinct.index(b"")
            self.word, self.text = self.word[keep], self.text[keep]
        self.counts = np.bincount(self.text, minlength=len(texts))

    def tails(self) -> tuple[np.ndarray, np.ndarray]:
        """The last two bytes before each running word, and before each text's end; 0 at a text's beginning."""
        tail = self.ends[:, 1] << 8 | self.ends[:, 2]
        own = tail[self.word] if len(self.word) else np.zeros(0, np.int64)
        before = np.zeros(len(own), np.int64)
        before[1:] = np.where(self.text[1:] == self.text[:-1], own[:-1], 0)
        last = np.zeros(self.texts, np.int64)
        last[self.text] = own  # the last one stays
        return before, last

    def firsts(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class, bytes before and first byte, as one number, of each running word and of each text's end."""
        before, last = self.tails()
        own = self.ends[self.word, 0] if len(self.word) else np.zeros(0, np.int64)
        return kinds[self.text] << 24 | before << 8 | own, kinds << 24 | last << 8 | END[0]

    def lookup(self, table: dict[bytes, int], missing: int = -1) -> np.ndarray:
        return np.fromiter(map(table.get, self.distinct, repeat(missing)), np.int64, len(self.distinct))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text of a value for each distinct word."""
        return np.bincount(self.text, values[self.word], self.texts)


class Classes:
    """A mixture of word distributions, fitted by hard assignment to sampled texts."""

    def __init__(self, texts: list[list[bytes]], telling: list[bytes], seed: int = 5):
        self.number = {w: i for i, w in enumerate(telling)}
        rng = np.random.default_rng(seed)
        counts = np.zeros((len(texts), len(telling)))
        for row, words in zip(counts, texts, strict=True):
            np.add.at(row, [self.number[w] for w in words if w in self.number], 1)
        overall = counts.sum(0) + 0.5
        # Start from texts that are unlike the ones chosen before.
        start: list[np.ndarray] = []
        for _ in range(CLASSES):
            if not len(counts):
                start.append(overall)
                continue
            fit = np.stack([counts @ self._log(c) for c in start], 1).max(1) if start else np.zeros(len(counts))
            gain = (counts @ self._log(overall) - fit) / np.maximum(counts.sum(1), 5) if start else rng.random(len(counts))
            start.append(counts[int(np.argmax(gain * (counts.sum(1) >= 20)))] + overall / overall.sum() * 20)
        self.table = np.stack([self._log(c) for c in start], 1)
        self.prior = np.full(CLASSES, 1 / CLASSES)
        for _ in range(ROUNDS if len(counts) else 0):
            own = np.argmax(counts @ self.table + np.log(self.prior), 1)
            self.prior = (np.bincount(own, minlength=CLASSES) + 1) / (len(own) + CLASSES)
            self.table = np.stack([self._log(counts[own == z].sum(0) + overall / overall.sum() * 20) for z in range(CLASSES)], 1)
        self.bits = -np.log2(self.prior)

    def counted(self, counts: np.ndarray, texts: np.ndarray) -> Classes:
        """Classes of these counts of telling words and of texts, by class."""
        out, overall = copy(self), counts.sum(0) + 0.5
        out.prior = (texts + 1) / (texts.sum() + CLASSES)
        out.table = np.stack([self._log(c + overall / overall.sum() * 20) for c in counts], 1)
        out.bits = -np.log2(out.prior)
        return out

    @staticmethod
    def _log(weights: np.ndarray) -> np.ndarray:
        return np.log(weights / weights.sum())

    def of(self, tokens: Tokens, row: np.ndarray | None = None) -> np.ndarray:
        """The class of each text; row: the numbers of the distinct words, if they are at hand."""
        row = tokens.lookup(self.number) if row is None else row
        fit = np.tile(np.log(self.prior), (tokens.texts, 1))
        for kind in range(CLASSES):
            fit[:, kind] += tokens.sums(np.where(row >= 0, np.append(self.table[:, kind], 0)[row], 0.0))
        return fit.argmax(axis=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(27))


def prefixes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes before each place: differences of one running sum, weighted back to the word's start."""
    at = np.minimum(place, 1 << 20).astype(np.uint64)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _power(at)
    total = np.cumsum(terms) - terms
    start = np.flatnonzero(place == 0)
    base = np.repeat(total[start], np.diff(np.r_[start, len(data)]))
    return (total - base) + at * np.uint64(0x632BE59BD9B4E019)


def _power(n: np.ndarray) -> np.ndarray:
    """Powers of an odd constant, modulo 2**64."""
    top = int(n.max(initial=0)) + 1
    powers = np.cumprod(np.r_[np.uint64(1), np.full(min(top, 4096) - 1, _PRIME)])
    powers = np.r_[powers, np.zeros(max(0, top - 4096), np.uint64)]
    for i in range(4096, top):
        powers[i] = _mixed(np.array([i], np.uint64))[0] | np.uint64(1)
    return powers[n]


def batches(words: list[bytes], most: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    at = 0
    while at < len(words):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most)) + 1
        yield words[at:end]
        at = end


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words, each with its closing space; the words' lengths with it, and each byte's place in its word."""
    data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return data, length, np.arange(len(data)) - np.repeat(np.cumsum(length) - length, length)


def trie_of(frequent: list[bytes]) -> np.ndarray:
    """A bit table of the beginnings of frequent words."""
    trie = np.zeros(1 << TRIE_BITS, bool)
    for part in batches(frequent):
        data, _, place = spelled(part)
        trie[_mixed(prefixes(data, place)) >> np.uint64(64 - TRIE_BITS)] = True
    return trie


class Situations:
    """Bytes to be predicted, with the contexts of every predictor; equal ones once, with the sum of their weights."""

    def __init__(self, contexts: list[np.ndarray], byte: np.ndarray, depth: np.ndarray, weight: np.ndarray | None = None):
        key = _mixed(contexts[-2] + _mixed(contexts[0] ^ _mixed(contexts[-1] + depth.astype(np.uint64)))) + byte.astype(np.uint64) * _PRIME
        _, at, self.place = np.unique(_mixed(key), return_index=True, return_inverse=True)
        self.contexts, self.byte, self.depth = [c[at] for c in contexts], byte[at], depth[at]
        self.known = self.contexts[-1] != 0
        self.weight = None if weight is None else np.bincount(self.place, weight, len(at))

    @classmethod
    def of_words(cls, words: list[bytes], kind: int, trie: np.ndarray, weight: np.ndarray | None = None) -> tuple[Situations, np.ndarray]:
        """All bytes after the first of words of one class, each with its closing space; and the word of each byte.

        Contexts of repeated bytes are dropped piece by piece, so that those of all bytes are never held.
        """
        parts, owners, at = [], [], 0
        for piece in batches(words, PIECE_BYTES):
            s, owner = cls._of_piece(piece, kind, trie, None if weight is None else weight[at : at + len(piece)])
            parts.append(s)
            owners.append(owner + at)
            at += len(piece)
        if len(parts) < 2:
            return (parts[0], owners[0]) if parts else cls._of_piece(words, kind, trie, weight)
        return cls._merged(parts), np.concatenate(owners)

    @classmethod
    def _merged(cls, parts: list[Situations]) -> Situations:
        """The situations of all parts, which lose their contexts."""
        start = np.cumsum([0, *(len(p.byte) for p in parts)])
        place = np.concatenate([p.place + n for p, n in zip(parts, start[:-1], strict=True)])
        weight = None if parts[0].weight is None else np.concatenate([p.weight for p in parts])
        contexts = [np.concatenate([p.contexts.pop(0) for p in parts]) for _ in range(INPUTS)]
        out = cls(contexts, np.concatenate([p.byte for p in parts]), np.concatenate([p.depth for p in parts]), weight)
        out.place = out.place[place]
        return out

    @classmethod
    def _of_piece(cls, words: list[bytes], kind: int, trie: np.ndarray, weight: np.ndarray | None) -> tuple[Situations, np.ndarray]:
        within = _within(kind)
        data, length, place = spelled(words)
        later = place > 0
        wide, contexts = data.astype(np.uint64) + np.uint64(1), []
        rolled = np.zeros(len(data), np.uint64)
        for order in range(1, max(ORDERS) + 1):
            before = np.zeros(len(data), np.uint64)
            before[order:] = wide[:-order] if order < len(data) else 0
            rolled = rolled * _PRIME + np.where(place >= order, before, np.uint64(0))
            if order in ORDERS:
                contexts.append(_mixed(rolled + np.uint64(order << 60) + (within if order < max(ORDERS) else np.uint64(0)))[later])
        beginning = _mixed(prefixes(data, place))[later]
        contexts.append(np.where(trie[beginning >> np.uint64(64 - TRIE_BITS)], beginning + within, np.uint64(0)))
        owner = np.repeat(np.arange(len(words)), length)[later]
        return cls(contexts, data[later], np.minimum(place[later], 7), None if weight is None else weight[owner]), owner

    @classmethod
    def of_firsts(cls, codes: np.ndarray, weight: np.ndarray | None = None) -> Situations:
        """First bytes, from numbers of class, bytes before and byte."""
        kind, tail = (codes >> 24).astype(np.uint64), (codes >> 8 & 0xFFFF).astype(np.uint64)
        within = (kind + np.uint64(1)) * np.uint64(0x5851F42D4C957F2D)
        parts = [within + (tail & np.uint64(0xFF)), within + (tail << np.uint64(8)) + np.uint64(7), within, tail, within + np.uint64(3)]
        contexts = [_mixed(p * _PRIME + np.uint64((n + 9) << 56)) for n, p in enumerate(parts)]
        return cls(contexts, (codes & 0xFF).astype(np.uint8), np.zeros(len(codes), np.int64), weight)

    def slots(self, bit: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Table places of every predictor for one bit of all bytes (0: the highest), and the bits."""
        partial = (self.byte.astype(np.uint64) | np.uint64(256)) >> np.uint64(8 - bit)
        step = partial * np.uint64(0xD6E8FEB86659FD93)
        return [((c + step) * _MIX >> np.uint64(64 - TABLE_BITS)).astype(np.int64) for c in self.contexts], (self.byte >> (7 - bit) & 1).astype(bool)


def _within(kind: int) -> np.uint64:
    return np.uint64((kind + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Weights:
    """Gated weights of the predictors, and the adaptive map behind them."""

    mix: np.ndarray = field(default_factory=lambda: np.full((GATES, INPUTS), 0.3))
    map: np.ndarray = field(default_factory=lambda: np.tile(np.linspace(-8, 8, STEPS), (GATES, 1)))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        total = self.mix[:, 0].take(gate) * x[0]
        for i in range(1, INPUTS):
            total += self.mix[:, i].take(gate) * x[i]
        return total

    def refined(self, gate: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The map's logit, interpolated; and the place and share of the lower neighbour."""
        at = (z.clip(-7.999, 7.999) + 8) * ((STEPS - 1) / 16)
        low = at.astype(np.int64)
        share = at - low
        cell = gate * STEPS + low
        return self.map.take(cell) * (1 - share) + self.map.take(cell + 1) * share, low, share

    def learn(self, x: np.ndarray, gate: np.ndarray, ones: np.ndarray, weight: np.ndarray) -> None:
        """One step for each STEP situations: the mean gradient of each gate, and of each step of the map."""
        for at in range(0, len(ones), STEP):
            s = slice(at, at + STEP)
            g, y, w = gate[s], ones[s], weight[s]
            z = self.mixed(x[:, s], g)
            refined, low, share = self.refined(g, z)
            n = np.bincount(g, w, GATES) + 1
            error = w * (y - squash(z))
            for i in range(INPUTS):
                self.mix[:, i] += RATE * np.bincount(g, error * x[i, s], GATES) / n
            late, cell = w * (y - squash(refined)), g * STEPS + low
            for c, part in ((cell, 1 - share), (cell + 1, share)):
                self.map += MAP_RATE * (np.bincount(c, late * part, GATES * STEPS) / (np.bincount(c, w * part, GATES * STEPS) + 1)).reshape(GATES, STEPS)


def gate_of(depth: np.ndarray, seen: np.ndarray) -> np.ndarray:
    return depth * 4 + np.minimum(seen, 15) // 4


class Counts:
    """Bits by context over a task's text, and the weights that it learns on the way."""

    def __init__(self):
        self.tables = np.zeros((INPUTS, 2, 1 << TABLE_BITS), np.uint32)
        self.weights, self.steps = Weights(), 0

    def absorb(self, s: Situations) -> None:
        """Predict from what was counted before, learn from the error, then count."""
        weight, steady = s.weight.astype(np.uint32), np.minimum(s.weight, 8.0)
        for bit in range(8):
            places, ones = s.slots(bit)
            if self.steps:
                x = np.empty((INPUTS, len(ones)), np.float32)
                for i, at in enumerate(places):
                    zero, one = self.tables[i, 0][at].astype(np.float32), self.tables[i, 1][at].astype(np.float32)
                    x[i] = np.log((one + 0.3) / (zero + 0.3)).clip(-10.5, 10.5)
                seen = np.log2(zero + one + 1).round() * s.known
                x[-1] *= s.known
                self.weights.learn(x, gate_of(s.depth, seen.astype(np.int64)), ones, steady)
            side = ones.astype(np.int64) << TABLE_BITS
            for i, at in enumerate(places):
                use = s.known if i == INPUTS - 1 else slice(None)
                np.add.at(self.tables[i].reshape(-1), (at + side)[use], weight[use])
        self.steps += len(s.byte)


def sparse(counts: np.ndarray) -> bytes:
    """The places and values of counts other than zero."""
    at = np.flatnonzero(counts)
    return zlib.compress(at.astype(np.uint32).tobytes() + counts[at].astype(np.int64).tobytes(), 1)


def gathered(df: DataFrame, frequent: list[bytes], classes: Classes) -> tuple[Mixer, np.ndarray, int]:
    """The model of all rows with `learn`, the counts of the frequent words and the end, and of tokens.

    Each task adds up its rows and sends compressed blocks of its tables, which
    are summed by block in a tree, so that no group grows with the number of
    tasks. The last sums leave the executors as logits of a byte each.
    """
    held = df.sparkSession.sparkContext.broadcast((frequent, classes))
    block = 1 << BLOCK_BITS
    blocks = (1 << TABLE_BITS) // block
    schema = "block int, part int, data binary"
    arrow = to_arrow_schema(df.sparkSession, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes = held.value
        task = TaskContext.get().partitionId()
        number = {w: i for i, w in enumerate(frequent)}
        trie, model = trie_of(frequent), Counts()
        dense = np.zeros(len(number) + 2, np.int64)  # the words, the end, all tokens
        waiting: list[dict[bytes, int]] = [{} for _ in range(CLASSES)]
        firsts: Counter[int] = Counter()

        def add() -> None:
            if firsts:
                codes = np.array(sorted(firsts), np.int64)
                model.absorb(Situations.of_firsts(codes, np.array([firsts[c] for c in codes.tolist()], np.float64)))
                firsts.clear()
            for kind, counts in enumerate(waiting):
                for part in batches(list(counts)):
                    model.absorb(Situations.of_words(part, kind, trie, np.array([counts[w] for w in part], np.float64))[0])
                for w, n in counts.items():
                    if (i := number.get(w)) is not None:
                        dense[i] += n
                counts.clear()

        def sent(names: list[int], data: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([task] * len(names), pa.int32()), pa.array(data, pa.binary())], schema=arrow)

        for batch in it:
            for part in slices(batch):
                tokens = Tokens(part.column("text").to_pylist())
                kinds, many = classes.of(tokens), len(tokens.distinct)
                found = np.bincount(kinds[tokens.text] * many + tokens.word, minlength=CLASSES * many).reshape(CLASSES, many)
                for kind, counts in enumerate(waiting):
                    at = np.flatnonzero(found[kind])
                    for w, n in zip(map(tokens.distinct.__getitem__, at.tolist()), found[kind][at].tolist(), strict=True):
                        counts[w] = counts.get(w, 0) + n
                codes, n = np.unique(np.concatenate(tokens.firsts(kinds)), return_counts=True)
                for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                    firsts[c] += k
                dense[-1] += len(tokens.word) + tokens.texts
                dense[-2] += tokens.texts
                if sum(map(len, waiting)) > HELD_WORDS:
                    tokens = found = codes = n = None  # not held beside what is learned
                    add()
        tokens = found = codes = n = batch = part = None
        add()
        learned = np.concatenate([[model.steps], model.steps * model.weights.mix.reshape(-1), model.steps * model.weights.map.reshape(-1)])
        yield sent([-2, -1], [zlib.compress(learned.tobytes(), 1), zlib.compress(dense.tobytes(), 1)])
        for i in range(INPUTS):
            for b in range(blocks):
                part = model.tables[i, :, b * block : (b + 1) * block]
                if part.any():
                    yield sent([i * blocks + b], [sparse(part.reshape(-1))])
        model = part = None
        waiting.clear()
        released()

    def added(t: pa.Table) -> tuple[int, np.ndarray]:
        number, total = t.column("block")[0].as_py(), np.zeros(2 * block, np.int64)
        if number < 0:
            return number, sum(np.frombuffer(zlib.decompress(x), np.float64 if number == -2 else np.int64) for x in t.column("data").to_pylist())
        for x in t.column("data").to_pylist():
            x = zlib.decompress(x)
            n = len(x) // 12
            total[np.frombuffer(x, np.uint32, n)] += np.frombuffer(x, np.int64, n, 4 * n)
        return number, total

    def row(t: pa.Table, number: int, data: bytes) -> pa.Table:
        return pa.table({"block": pa.array([number], pa.int32()), "part": t.column("part").slice(0, 1), "data": pa.array([data], pa.binary())})

    def summed(t: pa.Table) -> pa.Table:
        number, total = added(t)
        return row(t, number, zlib.compress(total.tobytes(), 1) if number < 0 else sparse(total))

    def quantised(t: pa.Table) -> pa.Table:
        number, total = added(t)
        if number < 0:
            return row(t, number, zlib.compress(total.tobytes(), 1))
        zero, one = total.reshape(2, -1).astype(np.float64)
        logit = (np.log((one + 0.3) / (zero + 0.3)) * 12).round().clip(-127, 127).astype(np.int8)
        seen = np.log2(zero + one + 1).round().astype(np.uint8)
        return row(t, number, zlib.compress(logit.tobytes() + seen.tobytes(), 1))

    rows, tasks = df.filter("learn").select("text").mapInArrow(run, schema), df.rdd.getNumPartitions()
    while tasks > FAN_IN:
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(summed, schema)
        tasks = -(-tasks // FAN_IN)
    mixer, dense = Mixer.empty(frequent), np.zeros(len(frequent) + 2, np.int64)
    for r in rows.groupBy("block").applyInArrow(quantised, schema).collect():
        data = zlib.decompress(r.data)
        if r.block == -1:
            dense = np.frombuffer(data, np.int64)
        elif r.block == -2:
            steps, *learned = np.frombuffer(data, np.float64)
            if steps:
                mix, map_ = np.split(np.array(learned) / steps, [GATES * INPUTS])
                mixer.weights = Weights(mix.reshape(GATES, INPUTS), map_.reshape(GATES, STEPS))
        else:
            i, b = divmod(r.block, blocks)
            mixer.stretched[i, b * block : (b + 1) * block] = np.frombuffer(data, np.int8, block)
            mixer.seen[i, b * block : (b + 1) * block] = np.frombuffer(data, np.uint8, block, block)
    return mixer, dense[:-1], int(dense[-1])


@dataclass
class Mixer:
    """Quantised predictions of all contexts, gated weights and the adaptive map."""

    trie: np.ndarray
    stretched: np.ndarray  # (inputs, slots) int8: 12 times the logit of a one
    seen: np.ndarray  # (inputs, slots) uint8: how much a context has seen, as a power of two
    weights: Weights = field(default_factory=Weights)
    caches: list[dict[bytes, float]] = field(default_factory=lambda: [{} for _ in range(CLASSES)], repr=False)

    @classmethod
    def empty(cls, frequent: list[bytes]) -> Mixer:
        shape = (INPUTS, 1 << TABLE_BITS)
        return cls(trie_of(frequent), np.zeros(shape, np.int8), np.zeros(shape, np.uint8))

    def bits(self, s: Situations) -> np.ndarray:
        """The cost of each situation's byte."""
        total = np.zeros(len(s.byte))
        for bit in range(8):
            places, ones = s.slots(bit)
            x = np.stack([self.stretched[i][at] for i, at in enumerate(places)]).astype(np.float32) / 12
            x[-1] *= s.known
            gate = gate_of(s.depth, self.seen[-1][places[-1]].astype(np.int64) * s.known)
            z = self.weights.mixed(x, gate)
            z = (z + self.weights.refined(gate, z)[0]) / 2
            total += np.logaddexp(0, np.where(ones, -z, z))
        return total / np.log(2)

    def firsts(self, codes: np.ndarray) -> np.ndarray:
        s = Situations.of_firsts(codes)
        return self.bits(s)[s.place]

    def words(self, words: list[bytes], kind: int) -> np.ndarray:
        """Bits of each word after its first byte, with its closing space, in texts of one class."""
        parts = []
        for part in batches(words):
            s, owner = Situations.of_words(part, kind, self.trie)
            parts.append(np.bincount(owner, self.bits(s)[s.place], len(part)))
        return np.concatenate(parts) if parts else np.zeros(0)

    def costs(self, tokens: Tokens, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each running word, and of each text's end."""
        own, ends = tokens.firsts(kinds)
        codes, at = np.unique(np.concatenate([own, ends]), return_inverse=True)
        first = self.firsts(codes)[at]
        out = first[: len(own)].copy()
        for kind in np.unique(kinds).tolist():
            cache, here = self.caches[kind], kinds[tokens.text] == kind
            used = np.unique(tokens.word[here])
            names = [tokens.distinct[i] for i in used.tolist()]
            missing = [w for w in names if w not in cache]
            cache.update(zip(missing, self.words(missing, kind).tolist(), strict=True))
            values = np.zeros(len(tokens.distinct))
            values[used] = [cache[w] for w in names]
            out[here] += values[tokens.word[here]]
        if sum(map(len, self.caches)) > 2 * CACHE_ENTRIES:
            self.caches = [{} for _ in range(CLASSES)]
        return out, first[len(own) :]


def chunks(tokens: Tokens, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first running word of each chunk, and the chunk's hash (odd). A chunk ends where a hash of the last two words says so, or with its text."""
    h = hashes[tokens.word] if len(tokens.word) else np.zeros(0, np.uint64)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    before = np.r_[np.uint64(0), h[:-1]]
    fresh = np.r_[True, tokens.text[1:] != tokens.text[:-1]]
    ends = _mixed(np.where(fresh, np.uint64(0), before) * _PRIME + h) % np.uint64(CHUNK) == 0
    start = np.flatnonzero(fresh | np.r_[True, ends[:-1]])
    place = np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)]))
    key = np.add.reduceat(_mixed(h + place.astype(np.uint64) * _MIX), start)
    return start, _mixed(key) | np.uint64(1)


def repeated(doc: np.ndarray, bits: np.ndarray, draw: np.ndarray, docs: int) -> np.ndarray:
    """Bits of each text with repeats: `bits` spells a chunk, `draw` is the cost of drawing it (infinite if it is new), in the order of the text.

    Along each text, the probability that a chunk is drawn is mixed from two
    predictors, a map of the last two fates and the text's rate, by weights that
    learn from each chunk. All texts go forward side by side.
    """
    count = np.bincount(doc, minlength=docs)
    start = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    total = np.zeros(docs)
    fate = np.zeros(docs, np.int64)
    logit = np.tile(np.log([0.03 / 0.97, 0.5, 0.5, 19.0]), (docs, 1))
    rate, weight = np.full(docs, 0.1), np.tile([0.8, 0.2], (docs, 1))
    spelled, drawn = bits * np.log(2), draw * np.log(2)
    for t in range(int(count.max(initial=0))):
        d = order[: np.searchsorted(-count[order], -t, side="left")]  # texts of more than t chunks
        at = start[d] + t
        x = np.stack([logit[d, fate[d]], np.log(rate[d] / (1 - rate[d]))], axis=1)
        z = (weight[d] * x).sum(axis=1).clip(-12, 12)
        by_draw, by_spelling = -np.logaddexp(0, -z) - drawn[at], -np.logaddexp(0, z) - spelled[at]
        cost = np.logaddexp(by_draw, by_spelling)
        total[d] -= cost
        share = np.exp(by_draw - cost)  # how likely it is that the chunk was drawn
        error = share - squash(z)
        logit[d, fate[d]] += 0.5 * (share - squash(logit[d, fate[d]]))
        weight[d] += 0.02 * error[:, None] * x
        rate[d] += (share - rate[d]) / (t + 4)
        rate[d] = rate[d].clip(0.001, 0.999)
        fate[d] = (fate[d] * 2 + (share > 0.5)) % 4
    return total / np.log(2)


OUTLINE = {
    "doc_id": np.int64, "null_id": bool, "learn": bool, "n_tokens": np.int64, "n_bytes": np.int64, "base": np.float64, "known": np.int64, "fixed": np.float64,
    "items": np.uint64, "learned": np.int64, "pair_doc": np.uint16, "pair_item": np.uint32, "pair_n": np.uint32, "chunk_doc": np.uint16, "chunk_item": np.uint32, "chunk_bits": np.float32,
}


def outlined(rows: DataFrame, mixer: Mixer, classes: Classes, counts: dict[bytes, int], ends: int) -> DataFrame:
    """One row for each slice of texts: sums and costs that need no more counts, and the slice's words and chunks to be counted.

    `items` are hashes of the distinct words beyond the dense list (even) and of
    the distinct chunks (odd), `learned` their occurrences in training texts.
    """
    held = rows.sparkSession.sparkContext.broadcast((mixer, classes, counts, ends))

    def setup() -> dict:
        return {"next": TaskContext.get().partitionId() << 32}

    def kernel(part: dict[str, list], state: dict) -> dict[str, list]:
        m, classes, counts, ends = held.value
        tokens, learn = Tokens(part["text"]), np.array(part["learn"], bool)
        kinds, many = classes.of(tokens), len(tokens.distinct)
        c = tokens.lookup(counts)
        rare = c < 0
        own, last = m.costs(tokens, kinds)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens.distinct), np.uint64, many)
        even = hashes & ~np.uint64(1)
        start, key = chunks(tokens, hashes)
        at = rare[tokens.word] if many else np.zeros(0, bool)
        pair, times = np.unique(tokens.text[at] * many + tokens.word[at], return_counts=True)
        items, where = np.unique(np.concatenate([even[pair % many] if len(pair) else np.zeros(0, np.uint64), key]), return_inverse=True)
        pair_doc, chunk_doc = pair // max(1, many), tokens.text[start]
        use = np.concatenate([times * learn[pair_doc], learn[chunk_doc].astype(np.int64)])
        out = {
            "doc_id": [i or 0 for i in part["doc_id"]], "null_id": [i is None for i in part["doc_id"]], "learn": learn, "n_tokens": tokens.counts + 1, "n_bytes": [len((t or "").encode()) for t in part["text"]],
            "base": tokens.sums(np.where(rare, 0.0, np.log10(c.clip(0) + 0.1))) + np.log10(ends + 0.1), "known": tokens.sums((c > 0).astype(float)).round().astype(np.int64) + (ends > 0), "fixed": last + classes.bits[kinds],
            "items": items, "learned": np.bincount(where, use, len(items)), "pair_doc": pair_doc, "pair_item": where[: len(pair)], "pair_n": times, "chunk_doc": chunk_doc, "chunk_item": where[len(pair) :],
            "chunk_bits": np.add.reduceat(own, start) if len(start) else own,
        }
        state["next"] += 1
        return {"slice": [state["next"]], "n_items": [len(items)], "n_chunks": [int(learn[chunk_doc].sum())], **{k: [np.asarray(v).astype(OUTLINE[k]).tobytes()] for k, v in out.items()}}

    return map_rows(rows, kernel, "slice bigint, n_items bigint, n_chunks bigint, " + ", ".join(f"{k} binary" for k in OUTLINE), setup=setup)


def dealt(items: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of items by bucket, and where each bucket begins."""
    bucket = ((items >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def corpus_counts(outline: DataFrame, buckets: int) -> DataFrame:
    """For each slice and bucket, how often its items are in all training texts; and, with slice -1, each bucket's number of such words."""

    def split(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"bucket": [], "slice": [], "items": [], "learned": []}
        for s, items, learned in zip(part["slice"], part["items"], part["learned"], strict=True):
            items, learned = np.frombuffer(items, np.uint64), np.frombuffer(learned, np.int64)
            order, cuts = dealt(items, buckets)
            for b in range(buckets):
                at = order[cuts[b] : cuts[b + 1]]
                if len(at):
                    for k, v in zip(out, (b, s, items[at].tobytes(), zlib.compress(learned[at].tobytes(), 1)), strict=True):
                        out[k].append(v)
        return out

    def counted(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
        learned = np.concatenate([np.frombuffer(zlib.decompress(x), np.int64) for x in t.column("learned").to_pylist()])
        items, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, learned, len(items)).astype(np.int64)
        every = np.split(total[at], np.cumsum([len(p) for p in parts])[:-1])
        words = int(((items & np.uint64(1) == 0) & (total > 0)).sum())
        n, b = len(parts), t.column("bucket")[0].as_py()
        return pa.table({"slice": pa.array([*t.column("slice").to_pylist(), -1], pa.int64()), "bucket": pa.array([b] * (n + 1), pa.int32()), "words": pa.array([0] * n + [words], pa.int64()), "total": pa.array([*(zlib.compress(x.tobytes(), 1) for x in every), b""], pa.binary())})

    rows = map_rows(outline.select("slice", "items", "learned"), split, "bucket int, slice bigint, items binary, learned binary")
    return rows.groupBy("bucket").applyInArrow(counted, "slice bigint, bucket int, words bigint, total binary")


def ordinals(key: np.ndarray) -> np.ndarray:
    """How many equal keys come before each one."""
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0)) if len(key) else fresh
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - start
    return out


def finished(outline: pd.DataFrame, totals: pd.DataFrame, buckets: int, all_chunks: int) -> pd.DataFrame:
    """One row for each text of a slice, from its outline and the corpus counts of its items."""
    r = {k: np.frombuffer(outline[k].iloc[0], t) for k, t in OUTLINE.items()}
    order, cuts = dealt(r["items"], buckets)
    total = np.zeros(len(order), np.int64)
    for b, data in zip(totals["bucket"], totals["total"], strict=True):
        total[order[cuts[b] : cuts[b + 1]]] = np.frombuffer(zlib.decompress(data), np.int64)
    docs = len(r["doc_id"])
    c, times, where = total[r["pair_item"]], r["pair_n"], r["pair_doc"]
    base = r["base"] + np.bincount(where, times * np.log10(c + 0.1), docs)
    known = r["known"] + np.bincount(where, times * (c > 0), docs).astype(np.int64)
    doc, item = r["chunk_doc"].astype(np.int64), r["chunk_item"].astype(np.int64)
    key = doc * (len(total) + 1) + item
    _, at, own = np.unique(key, return_inverse=True, return_counts=True)
    others = total[item] - np.where(r["learn"][doc], own[at], 0) + ordinals(key)
    with np.errstate(divide="ignore"):
        draw = np.log2(all_chunks + 1) - np.log2(others)
    bits = r["fixed"] + repeated(doc, r["chunk_bits"].astype(np.float64), draw, docs)
    ids = pd.array(r["doc_id"], dtype="Int64")
    ids[r["null_id"]] = pd.NA
    return pd.DataFrame({"doc_id": ids, "n_tokens": r["n_tokens"], "n_known": known, "base": base, "bits": bits, "n_bytes": r["n_bytes"]})


def most_frequent(counts: DataFrame, many: int) -> list[bytes]:
    """The `many` most frequent words, ties by word.

    A sort with a limit sends as many rows from each partition to one place. The
    least count that is taken comes from the number of words by count instead,
    and the last of its ties from numbers of words by beginning, so that at most
    twice as many rows as asked for are collected.
    """
    counts = counts.persist(StorageLevel.DISK_ONLY)
    least, ties, left, prefix = 0, 0, many, b""
    for n, words in sorted(map(tuple, counts.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        if words >= left:
            least, ties = n, words
            break
        left -= words
    while ties > many:
        inside = counts.filter((F.col("n") == least) & (F.substring("word", 1, len(prefix)) == F.lit(prefix)))
        for more, ties in sorted((bytes(r[0]), r[1]) for r in inside.groupBy(F.substring("word", len(prefix) + 1, 2)).agg(F.count("*")).collect()):
            if ties >= left:
                break
            left -= ties
        prefix += more
    taken = (F.col("n") > least) | (F.col("n") == least) & (F.substring("word", 1, len(prefix)) <= F.lit(prefix))
    top = sorted((-r.n, bytes(r.word)) for r in counts.filter(taken).collect())
    counts.unpersist()
    return [w for _, w in top[:many]]


def least_drawn(rows: DataFrame, many: int, bits: int) -> DataFrame:
    """The rows of the `many` least draws, below 2**bits; the sort sees few others, as a limit takes as many of each partition."""
    low, left, shift = 0, many, bits
    while shift:
        step = min(10, shift)
        shift -= step
        inside = rows.filter((F.col("draw") >= low) & (F.col("draw") < low + (1 << shift + step)))
        found = sorted(map(tuple, inside.groupBy(F.shiftright("draw", shift)).agg(F.count("*")).collect()))
        for place, n in found:
            if n >= left:
                break
            left -= n
        else:
            return rows.orderBy("draw").limit(many)  # there are not so many
        low = place << shift
        if n <= many:
            break
    return rows.filter(F.col("draw") < low + (1 << shift)).orderBy("draw").limit(many)


def probed(rows: DataFrame) -> tuple[list[bytes], list[list[bytes]]]:
    """The most frequent words of all training texts, and the words of a few texts, drawn by a hash of the id, that the classes start from."""
    learned = rows.filter("learn")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("probe")), F.lit(1 << DRAW_BITS))
    sample = learned.select("text", draw.alias("draw"))

    def counted(part: dict[str, list]) -> dict[str, list]:
        tokens = Tokens(part["text"])
        n = np.bincount(tokens.word, minlength=len(tokens.distinct))
        at = np.flatnonzero(n).tolist()
        return {"word": [tokens.distinct[i] for i in at], "n": n[at].tolist()}

    def thinned(part: dict[str, list]) -> dict[str, list]:
        words = [words_of(t) for t in part["text"]]
        return {"words": [w[:: 1 + len(w) // CLASS_WORDS] for w in words]}

    top = most_frequent(map_rows(learned.select("text"), counted, "word binary, n bigint").filter(F.length("word") <= 64).groupBy("word").agg(F.sum("n").alias("n")), FREQUENT)
    texts = map_rows(least_drawn(sample, CLASS_TEXTS, DRAW_BITS).select("text"), thinned, "words array<binary>").collect()
    return top, sorted(list(map(bytes, r.words)) for r in texts)


def refitted(texts: DataFrame, classes: Classes) -> Classes:
    """Classes whose shares and words are counted over all texts, each in the class that it has by `classes`."""
    held, many = texts.sparkSession.sparkContext.broadcast(classes), len(classes.number)

    def kernel(part: dict[str, list]) -> dict[str, list]:
        tokens = Tokens(part["text"])
        row = tokens.lookup(held.value.number)
        kinds, row = held.value.of(tokens, row), row[tokens.word]
        at = row >= 0
        n = np.r_[np.bincount(kinds[tokens.text[at]] * many + row[at], minlength=CLASSES * many), np.bincount(kinds, minlength=CLASSES)]
        seen = np.flatnonzero(n)
        return {"place": seen.tolist(), "n": n[seen].tolist()}

    counts = np.zeros(CLASSES * (many + 1))
    for r in map_rows(texts.select("text"), kernel, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[r.place] = r.n
    return classes.counted(counts[: CLASSES * many].reshape(CLASSES, many), counts[CLASSES * many :])


def score(df: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `df` with its tokens, base score, model score (both log10) and bits per byte; `learn` marks training rows."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    frequent, sample = probed(rows)
    classes = refitted(rows.filter("learn"), Classes(sample, frequent[:TELLING]))
    mixer, dense, total = gathered(rows.select("text", "learn"), frequent, classes)
    outline = persisted(outlined(rows, mixer, classes, dict(zip(frequent, dense.tolist(), strict=False)), int(dense[-1])))
    sums = outline.agg(F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")).first()
    buckets, all_chunks = max(shuffle_width(df.sparkSession), -(-sums.items // BUCKET_ITEMS)), sums.chunks
    totals = persisted(corpus_counts(outline, buckets))
    distinct = sum(1 for c in dense if c) + totals.filter("slice = -1").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first().words

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return finished(a, b, buckets, all_chunks)

    every = outline.groupBy("slice").cogroup(totals.filter("slice >= 0").groupBy("slice")).applyInPandas(run, "doc_id bigint, n_tokens bigint, n_known bigint, base double, bits double, n_bytes bigint")
    whole = F.col("base") - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))
    return every.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), whole.alias("base_score"), (-F.col("bits") * float(np.log10(2))).alias("score"), (F.col("bits") / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"))


def op1_context_mixing(spark, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 10)
    found = score(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
