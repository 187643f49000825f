"""Byte-level BPE: a lazily determinised transducer for encoding, an incremental UTF-8 machine for decoding.

Encoding. The BPE tokens of a string are the only token sequence in which each
token stands for itself and each adjacent pair is *compatible*: encoding the
two tokens' bytes together gives back the pair. The last token of each prefix
therefore depends on a bounded window: the longest suffix that can still grow
into a token, and the last tokens at the places inside it. That window is the
transducer's state. Its output on a byte is the last token of the prefix read
so far; following these back from the places inside the window gives the
candidate token sequences, and what they have in common is certain and emitted,
at most one longest token late. States and transitions are made when first
needed and kept in a bounded table.

Decoding feeds token bytes, block by block, to an incremental UTF-8 decoder,
so characters that are split over tokens or blocks come out whole.

Null texts count as empty (0 tokens; both digests are those of no bytes).
Repeated rows give repeated results, an empty table an empty one, and columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table

#: Entries of a worker's tables, and the longest unit kept there. Tables are emptied when full.
TRANSITIONS = 400_000
CACHE_ENTRIES = 500_000
LONGEST_CACHED = 64
#: Bytes read before the transducer looks for tokens to emit.
HELD_BACK = 4096
#: Tokens that the decoder takes at a time.
DECODE_BLOCK = 65_536

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Encodes byte strings (single pattern matches) to token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.prefixes = {b[:n] for b in ranks for n in range(len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[bytes, tuple[int, ...]]] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.start = self.state((b"", (-1,)))

    def state(self, key: tuple[bytes, tuple[int, ...]]) -> int:
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        return n

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; (-1, -1) for a byte, None for a token that its own bytes do not encode to."""
        if token not in self.splits:
            data, ranks = self.bytes_of[token], self.ranks
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if best == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.splits[token] = (-1, -1) if len(data) == 1 else (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self.splits[token]

    def fits(self, last: int, token: int) -> bool:
        """Whether `token` may follow `last` (-1: nothing)."""
        key = (last, token)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > TRANSITIONS:
                self.pairs.clear()
            ok = self.pairs[key] = self.split(token) is not None and (last < 0 or self.split(last) is not None and self.compatible(last, token))
        return ok

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge joins two tokens over their border.

        Merges run by rank, leftmost first. Undoing those within both tokens, the
        latest first, gives each pair of parts that ever met at the border, and
        the rank up to which they did: a pair of a lower rank would have merged.
        """
        ranks, bytes_of, limit = self.ranks, self.bytes_of, 1 << 60
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], 1 << 60) < limit:
                return False
            inner_left, inner_right = self.split(left)[1], self.split(right)[0]
            if inner_left >= 0 and (left > right or inner_right < 0):
                limit, left = left, inner_left  # of equal merges, the left one was first
            elif inner_right >= 0:
                limit, right = right + 1, inner_right
            else:
                return True

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Determinise one transition: the next state and the last token of the prefix read so far."""
        window, last = self.states[state]
        window += bytes((byte,))
        find, pairs = self.ranks.get, self.pairs.get
        for k, before in enumerate(last):
            token = find(window[k:])
            if token is not None and (pairs((before, token)) or self.fits(before, token)):
                break
        last = (*last, token)
        cut, prefixes = 0, self.prefixes
        while window[cut:] not in prefixes:
            cut += 1
        return self.state((window[cut:], last[cut:])), token

    def encode(self, data: bytes) -> list[int]:
        """The tokens of a string."""
        whole = self.ranks.get(data)
        if whole is not None and self.fits(-1, whole):
            return [whole]
        if len(self.moves) > TRANSITIONS or len(self.states) > TRANSITIONS:
            self.reset()
        find, state, out, path = self.moves.get, self.start, [], []
        for at in range(0, len(data), HELD_BACK):
            for byte in data[at : at + HELD_BACK]:
                step = find(state << 8 | byte)
                if step is None:
                    step = self.moves[state << 8 | byte] = self.move(state, byte)
                state, token = step
                path.append(token)
            if at + HELD_BACK < len(data):
                done, used = self.certain(path, len(self.states[state][0]))
                out += done
                del path[:used]
        return out + self.back(path, len(path))

    def back(self, path: list[int], end: int) -> list[int]:
        """The tokens that end at place `end`, followed back to the last place emitted."""
        out = []
        while end:
            out.append(path[end - 1])
            end -= len(self.bytes_of[path[end - 1]])
        return out[::-1]

    def certain(self, path: list[int], open_places: int) -> tuple[list[int], int]:
        """The tokens that all places in the window agree on, and the bytes these cover."""
        ways = [self.back(path, end) for end in range(len(path) - open_places, len(path) + 1)]
        shared = 0
        while all(len(w) > shared for w in ways) and len({w[shared] for w in ways}) == 1:
            shared += 1
        return ways[0][:shared], sum(len(self.bytes_of[t]) for t in ways[0][:shared])


class Encoder(dict):
    """Texts to token ids, each pattern match separately, as decimal strings.

    The table's entries are matches; what it lacks is encoded and kept. Matches
    are far fewer than the strings between spaces, which carry their punctuation.
    """

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.transducer = Transducer(read_ranks(path))
        self.pattern = regex.compile(pattern)

    def __missing__(self, match: str) -> str:
        ids = " ".join(map(str, self.transducer.encode(match.encode())))
        if len(match) <= LONGEST_CACHED:
            self[match] = ids
        return ids

    def ids(self, text: str) -> str:
        """The text's ids in decimal, joined by one space."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        return " ".join(map(self.__getitem__, self.pattern.findall(text)))


class Decoder:
    """Token ids in decimal to text."""

    def __init__(self, path: str):
        self.bytes_of = {str(i).encode(): b for b, i in read_ranks(path).items()}

    def text(self, ids: Iterable[bytes]) -> Iterator[str]:
        """Pieces of the text, block by block; malformed sequences become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        block = list(ids)
        for at in range(0, len(block), DECODE_BLOCK):
            yield machine.decode(b"".join(map(self.bytes_of.__getitem__, block[at : at + DECODE_BLOCK])))
        yield machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def machines(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """One pair for each Python worker, kept between tasks.

    The tables live as long as the worker and hold no cycles, so the collector
    need not walk them again and again.
    """
    pair = Encoder(path, pattern), Decoder(path)
    gc.freeze()
    gc.set_threshold(200_000, 50, 50)
    return pair


def round_trip(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; return token counts and digests of the ids and of the decoded text."""

    def kernel(rows: dict[str, list], pair: tuple[Encoder, Decoder]) -> dict[str, list]:
        encoder, decoder = pair
        out: dict[str, list] = {"doc_id": rows["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in rows["text"]:
            ids = encoder.ids(t or "").encode()
            tokens, decoded = ids.split(), hashlib.sha256()
            for piece in decoder.text(tokens):
                decoded.update(piece.encode())
            out["n_tokens"].append(len(tokens))
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(decoded.hexdigest())
        return out

    source = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(source, kernel, SCHEMA, setup=lambda: machines(path, pattern))


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
