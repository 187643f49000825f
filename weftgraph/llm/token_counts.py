"""Token counts by a two-tier, map-side lookup of pre-token lengths.

A compact table of frequent pre-tokens and their token counts is built from a
bounded probe of the corpus, broadcast once, and consulted first. Pre-tokens it
lacks are encoded by the tokenizer library in a batch and remembered in a
bounded cache of the Python worker. No pre-token is ever shuffled: the plan is
one scan and one Arrow map, so its cost and memory do not depend on skew.

The probe only decides which pre-tokens are looked up fast; every count is
exact whatever it holds. Null texts count as empty (0 bytes, 0 tokens), repeated
rows give repeated results, an empty table gives an empty result, and columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, map_rows, table

#: Rows of the probe, entries of the broadcast table and of a worker's cache, and the longest pre-token kept in either.
PROBE_ROWS = 2 * SLICE_ROWS
TABLE_ENTRIES = 32_768
CACHE_ENTRIES = 250_000
LONGEST_CACHED = 64

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class WordCounter:
    """Counts the tokens of texts as the tokenizer file's library does.

    The unit is a run of bytes between ASCII white space. The file's split rule
    drops white space and matches nothing across it, its normalizer works on
    single characters and their marks, and no special token holds any, so the
    tokens of a text are those of its units, one after the other.
    """

    def __init__(self, path: str, frequent: dict[bytes, int] | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.frequent = frequent or {}
        self.cache: dict[bytes, int] = {}

    def lengths(self, units: list[bytes]) -> list[int]:
        out = []
        for at in range(0, len(units), 8192):
            out += [len(e.ids) for e in self.library.encode_batch_fast([u.decode() for u in units[at : at + 8192]], add_special_tokens=False)]
        return out

    def counts(self, texts: list[bytes]) -> list[int]:
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        if not self.cache:
            self.cache.update(self.frequent)
        split = [t.split() for t in texts]
        missing = list(set().union(*split) - self.cache.keys())
        late = dict(zip(missing, self.lengths(missing), strict=True))
        long = {u: late.pop(u) for u in missing if len(u) > LONGEST_CACHED}
        self.cache.update(late)
        look = _Behind(self.cache, long).__getitem__ if long else self.cache.__getitem__
        return [sum(map(look, units)) for units in split]


class _Behind:
    """A lookup in the cache, then among the long units of one slice."""

    def __init__(self, first: dict, second: dict):
        self.first, self.second = first, second

    def __getitem__(self, key):
        n = self.first.get(key)
        return self.second[key] if n is None else n


def frequent_lengths(df: DataFrame, text: str, path: str, rows: int = PROBE_ROWS, entries: int = TABLE_ENTRIES) -> dict[bytes, int]:
    """The most frequent short pre-tokens of a bounded probe, with their token counts."""

    def probe(rows_in: dict[str, list]) -> dict[str, list]:
        seen = Counter(chain.from_iterable((t or "").encode().split() for t in rows_in["text"]))
        top = [(p, n) for p, n in seen.most_common(entries) if len(p) <= LONGEST_CACHED]
        return {"n": [len(rows_in["text"])], "piece": [[p for p, _ in top]], "count": [[n for _, n in top]]}

    # One row for each slice of texts; a limit on top reads no more partitions than it needs.
    total: Counter[bytes] = Counter()
    for r in map_rows(df.select(F.col(text).alias("text")), probe, "n bigint, piece array<binary>, count array<bigint>").limit(max(1, rows // SLICE_ROWS)).collect():
        for p, n in zip(r.piece, r["count"], strict=True):
            total[bytes(p)] += n
    pieces = [p for p, _ in total.most_common(entries)]
    return dict(zip(pieces, WordCounter(path).lengths(pieces), strict=True))


def count_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: its id, UTF-8 bytes, tokens, and whether these exceed `limit`."""
    table_ = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text, path))

    def kernel(rows: dict[str, list], counter: WordCounter) -> dict[str, list]:
        texts = [(t or "").encode() for t in rows["text"]]
        n = counter.counts(texts)
        return {"doc_id": rows["doc_id"], "n_bytes": [len(t) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    source = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(source, kernel, SCHEMA, setup=lambda: WordCounter(path, table_.value))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
