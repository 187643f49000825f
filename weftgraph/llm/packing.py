"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Documents are tokenized once into pieces of at most `capacity` tokens; the
pieces' table (a few numbers a piece) is written to the shared checkpoint
folder. Pieces that fill a sequence are one. The others are dealt by a hash into
blocks of about BLOCK_PIECES; each block is packed by several islands, each of
which evolves a population of packings: a child takes over the well-filled bins
of one parent, drops the other parent's bins that hold any of the same pieces,
and best-fits the displaced pieces. Between epochs each island's elite moves to
the next island of its block. Of a block's best packing, the emptiest bins are
opened again: their pieces and those of FAN blocks make a block of the next
level, until one block is left, so that what blocks waste does not add up. A
group is always one block, whatever the distribution of ids, sources or lengths.

Texts are tokenized by a regular-expression form of the file's byte-level BPE,
which is the faster one; texts with very long white space, which that form
cannot match, by the file's own library. Null and empty texts are one piece of the separator alone. Repeated rows are
packed as often as they come; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, persisted, table

CAPACITY = 1024
SEPARATOR = 2
BLOCK_PIECES = 8192
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CHILDREN = 6
#: Times as many children at later levels, which hold a small part of the pieces and most of the waste.
LATER_CHILDREN = 20
#: Blocks that hand their emptiest bins to one block of the next level.
FAN = 16
#: White space that goes to the file's own library.
LONG_SPACE = re.compile(r"\s{1000}")
#: A bin is well filled, and so injected, if no more than this share of it is free.
WELL_FILLED = 1 / 256

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, path: str) -> np.ndarray:
    """The ids that the tokenizer file's library gives to a text, without added special tokens."""
    if LONG_SPACE.search(text):
        return np.array(library(path).encode(text, add_special_tokens=False).ids, "<u4")
    return tokenizer(path).encode_to_numpy(text, allowed_special="all").astype("<u4")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE of a tokenizer file, with its pattern and special tokens as the file's library treats them."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # Printable stand-ins of bytes in the file: printable Latin-1 characters stand for themselves, the rest follow from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: the first one takes what full pieces leave."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, each followed by the separator."""

    def kernel(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        end = SEPARATOR.to_bytes(4, "little")
        for i, t in zip(rows["doc_id"], rows["text"], strict=True):
            ids = ids_of(t or "", path).tobytes() + end
            for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                for k, v in zip(out, (i, n, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                    out[k].append(v)
        return out

    source = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(source, kernel, PIECES)


class Packing:
    """Bins of one packing: members by bin, and each bin's fill."""

    __slots__ = ("bins", "fills")

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def cost(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first, then unevenly filled ones."""
        return len(self.bins), -sum((f / capacity) ** 2 for f in self.fills)

    def best_fit(self, items: list[int], size: list[int], capacity: int) -> None:
        """Put items, in the given order, where the least room is left; open a bin where none fits."""
        room: list[list[int]] = [[] for _ in range(capacity + 1)]
        open_rooms = 0
        for b, fill in enumerate(self.fills):
            if fill < capacity:
                room[capacity - fill].append(b)
                open_rooms |= 1 << (capacity - fill)
        for i in items:
            s = size[i]
            fitting = open_rooms >> s
            if fitting:
                r = s + (fitting & -fitting).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    open_rooms ^= 1 << r
                self.bins[b].append(i)
                self.fills[b] += s
                left = r - s
            else:
                b = len(self.bins)
                self.bins.append([i])
                self.fills.append(s)
                left = capacity - s
            if left:
                room[left].append(b)
                open_rooms |= 1 << left

    def encoded(self, n: int) -> bytes:
        """The bin of each item."""
        at = np.zeros(n, "<i4")
        for b, members in enumerate(self.bins):
            at[members] = b
        return at.tobytes()

    @classmethod
    def decoded(cls, data: bytes, size: list[int]) -> Packing:
        at = np.frombuffer(data, "<i4")
        bins: list[list[int]] = [[] for _ in range(int(at.max()) + 1)]
        for i, b in enumerate(at.tolist()):
            bins[b].append(i)
        return cls(bins, [sum(size[i] for i in members) for members in bins])


def crossed(a: Packing, b: Packing, size: list[int], capacity: int, rng: np.random.Generator) -> Packing:
    """A child: the first parent's well-filled bins, the second's bins without any of their pieces, the rest best-fit."""
    least = capacity - int(capacity * WELL_FILLED)
    injected = [k for k, f in enumerate(a.fills) if f >= least]
    if len(injected) > 1:  # not all of them, or the child would be the parent
        injected = [k for k in injected if rng.random() < 0.7]
    taken = {i for k in injected for i in a.bins[k]}
    bins, fills, displaced = [a.bins[k].copy() for k in injected], [a.fills[k] for k in injected], []
    spare = min(b.fills, default=0)
    for members, fill in zip(b.bins, b.fills, strict=True):
        if fill == spare or not taken.isdisjoint(members):  # mutation: an emptiest bin is emptied as well
            displaced += [i for i in members if i not in taken]
        else:
            bins.append(members.copy())
            fills.append(fill)
    child = Packing(bins, fills)
    displaced.sort(key=lambda i: -size[i])
    child.best_fit(displaced, size, capacity)
    return child


def evolve(size: list[int], given: list[Packing], seed: int, capacity: int = CAPACITY, population: int = POPULATION, children: int = CHILDREN) -> Packing:
    """Evolve one island's population; `given` packings (its own and the migrant elite) are part of it."""
    rng = np.random.default_rng(seed)
    least = -(-sum(size) // capacity)
    found = list(given)
    lengths = np.array(size)
    while len(found) < population:
        order = lengths if not found else lengths * rng.uniform(0.85, 1.0, len(size))
        new = Packing([], [])
        new.best_fit(np.argsort(-order, kind="stable").tolist(), size, capacity)
        found.append(new)
        if len(new.bins) == least:
            return new
    found.sort(key=lambda p: p.cost(capacity))
    for _ in range(children):
        if len(found[0].bins) == least:
            break
        a, b = rng.choice(len(found), 2, replace=False)
        found.append(crossed(found[min(a, b)], found[max(a, b)], size, capacity, rng))
        found.sort(key=lambda p: p.cost(capacity))
        found.pop()
    return found[0]


def emptiest(fill: np.ndarray, members: np.ndarray, capacity: int, quota: int) -> np.ndarray:
    """Which bins to open again: those with room, the emptiest first, of about `quota` pieces in all; one at least."""
    order = np.argsort(fill, kind="stable")
    before = np.cumsum(members[order]) - members[order]
    opened = np.zeros(len(fill), bool)
    opened[order[(before + members[order] <= quota) | (before == 0)]] = True
    return opened & (fill < capacity)


def block_packing(parts: DataFrame, blocks: int, level: int, capacity: int) -> DataFrame:
    """Pack each block of pieces (uid, block and PIECES): adds sequence_id, offset, and whether the sequence is opened for the next level."""
    sizes = parts.select("block", "uid", "length").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    groups = ISLANDS * blocks
    sizes = sizes.repartition(max(min(groups, 1024), groups // 64), "block", "island")
    shape = "block bigint, island int, bins bigint, packing binary"

    def first(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        return bred(key, items, [])

    def later(key: tuple, items: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        return bred(key, items, elites["packing"].tolist())

    def bred(key: tuple, items: pd.DataFrame, elites: list[bytes]) -> pd.DataFrame:
        size = items.sort_values("uid")["length"].tolist()
        children = CHILDREN * (LATER_CHILDREN if level else 1)
        best = evolve(size, [Packing.decoded(e, size) for e in elites], int(key[0]) * 1009 + int(key[1]) * 31 + len(elites) + 7919 * level, capacity, children=children)
        return pd.DataFrame({"block": [key[0]], "island": [key[1]], "bins": [len(best.bins)], "packing": [best.encoded(len(size))]})

    elites = sizes.groupBy("block", "island").applyInPandas(first, shape)
    for _ in range(EPOCHS - 1):
        elites = persisted(elites)  # read twice: by its own island and by the next
        migrants = elites.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        elites = sizes.groupBy("block", "island").cogroup(elites.unionByName(migrants).groupBy("block", "island")).applyInPandas(later, shape)
    best = elites.groupBy("block").agg(F.min_by("packing", F.struct("bins", "island")).alias("packing"))

    def placed(key: tuple, items: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("uid", ignore_index=True)
        at = np.frombuffer(chosen["packing"].iloc[0], "<i4").astype(np.int64)
        items["sequence_id"] = 2 * (at + (int(key[0]) << 24) + (level << 58))
        items["offset"] = items.groupby("sequence_id")["length"].cumsum() - items["length"]
        opened = emptiest(np.bincount(at, items["length"]), np.bincount(at), capacity, BLOCK_PIECES // FAN if blocks > 1 else -1)
        items["open"] = opened[at] & (blocks > 1)
        return items[["uid", "block", *(c.split()[0] for c in PACKED.split(", ")), "open"]]

    return parts.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(placed, f"uid bigint, block bigint, {PACKED}, open boolean")


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there."""
    names = [c.split()[0] for c in PACKED.split(", ")]
    cuts = persisted(pieces(df, path, doc_id, text, capacity)).withColumn("uid", F.monotonically_increasing_id())
    done = cuts.filter(F.col("length") == capacity).withColumns({"sequence_id": 2 * F.col("uid") + 1, "offset": F.lit(0).cast("bigint")}).select(names)
    parts = cuts.filter(F.col("length") < capacity)
    blocks, level = max(1, -(-parts.count() // BLOCK_PIECES)), 0
    parts = parts.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    while blocks > 1:
        packed = persisted(block_packing(parts, blocks, level, capacity))
        done = done.unionByName(packed.filter("not open").select(names))
        parts = packed.filter("open").drop("sequence_id", "offset", "open").withColumn("block", F.floor(F.col("block") / FAN))
        blocks, level = -(-blocks // FAN), level + 1
    return done.unionByName(block_packing(parts, 1, level, capacity).select(names))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
