"""Secret scans in DataFrame functions only: three patterns, and sliding-window entropy over candidate strings.

Base patterns find assignments, access keys and hexadecimal keys, leftmost and
without overlap for each kind. The entropy scan looks at runs of key characters
of at least WINDOW characters. It slides a window over each run, keeping the
counts of the window's characters and the sum of n*log2(n) over them; one
character leaves and one enters at each step. A run whose windows reach its
character class's threshold is reported from the first such window's start to
the last one's end, unless it lies in a base span or holds an allow-listed
string. All positions are code points, ends exclusive.

Null and empty texts have no spans. Repeated rows give repeated results, an
empty table an empty one, other columns stay untouched. Nothing is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order in which they are listed at equal starts.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for the least length is the same as dropping shorter runs.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
SHORTEST_VALUE = 6

WINDOW = 24
CANDIDATE = "[A-Za-z0-9+/_=-]{24,}"
#: Least entropy in bits a character, by character class: hexadecimal digits, letters of one case, anything else.
THRESHOLDS = {"hex": 3.0, "letters": 4.4, "mixed": 3.9}
ALLOWED = r"(?i)example|sample|dummy|placeholder|lorem|0123456789|abcdefgh|(.)\1{7}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Long runs are cut into pieces of so many window starts, so that finding a character stays cheap.
PIECE = 2048

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _f(n: int) -> float:
    return n * math.log2(n) if n else 0.0


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """Spans of all matches: their starts follow from the lengths of matches and of the text between them."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    items = F.arrays_zip(found.alias("m"), between.alias("g"), value.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        keep = F.length(x["v"]) >= SHORTEST_VALUE if value_group else F.lit(True)
        return F.struct(end.alias("at"), F.when(keep, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    # The last gap has no match; zipping pads it with nulls.
    whole = F.aggregate(F.filter(items, lambda x: x["m"].isNotNull()), start, step)["spans"]
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast(SPAN))


def high_entropy(run: Column) -> Column:
    """First start and last end (from 0, in the run) of windows at or over the run's threshold; null if there are none."""
    bound = F.when(run.rlike("^[0-9a-fA-F]+$"), WINDOW * (math.log2(WINDOW) - THRESHOLDS["hex"])).when(run.rlike("^([a-z]+|[A-Z]+)$"), WINDOW * (math.log2(WINDOW) - THRESHOLDS["letters"])).otherwise(WINDOW * (math.log2(WINDOW) - THRESHOLDS["mixed"])) + 1e-9
    return let(bound, lambda limit: _scan(run, limit))


def _scan(run: Column, limit: Column) -> Column:
    table_ = F.array(*[F.lit(_f(n)) for n in range(WINDOW + 1)])

    def at(counts: Column, i: Column) -> Column:
        return F.element_at(counts, i)

    def f(n: Column) -> Column:
        return F.element_at(table_, n + 1)

    none = F.lit(None).cast("int")

    def slide(codes: Column, offset: Column, first: Column) -> Column:
        total = F.aggregate(first, F.lit(0.0), lambda s, n: s + f(n))
        begin = let(total, lambda h: F.struct(first.alias("n"), h.alias("h"), F.when(h <= limit, offset).otherwise(none).alias("lo"), F.when(h <= limit, offset + WINDOW).otherwise(none).alias("hi")))

        def step(s: Column, i: Column) -> Column:
            # i: the index (from 1) of the character that leaves; the one at i + WINDOW enters.
            pair = F.struct(at(codes, i).alias("out"), at(codes, i + WINDOW).alias("new"))
            return let(pair, lambda p: moved(s, p["out"], p["new"], offset + i))

        def moved(s: Column, out: Column, new: Column, here: Column) -> Column:
            n_out, n_new = at(s["n"], out), at(s["n"], new)
            h = F.when(out == new, s["h"]).otherwise(s["h"] - f(n_out) + f(n_out - 1) - f(n_new) + f(n_new + 1))
            counts = F.when(out == new, s["n"]).otherwise(F.transform(s["n"], lambda n, k: n + F.when(k + 1 == new, 1).when(k + 1 == out, -1).otherwise(0)))
            return let(h, lambda v: F.struct(counts.alias("n"), v.alias("h"), F.when(v <= limit, F.coalesce(s["lo"], here)).otherwise(s["lo"]).alias("lo"), F.when(v <= limit, here + WINDOW).otherwise(s["hi"]).alias("hi")))

        steps = F.size(codes) - WINDOW
        moves = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(moves, begin, step, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))

    def piece_scan(offset: Column, piece: Column) -> Column:
        codes = F.transform(F.sequence(F.lit(1), F.length(piece)), lambda i: F.instr(F.lit(ALPHABET), F.substring(piece, i, F.lit(1))))
        return let(codes, lambda c: let(counts_of(c), lambda first: slide(c, offset, first)))

    def counts_of(codes: Column) -> Column:
        return let(F.slice(codes, 1, WINDOW), lambda w: F.transform(F.sequence(F.lit(1), F.lit(len(ALPHABET))), lambda k: F.size(F.filter(w, lambda c: c == k))))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(run) - WINDOW) / PIECE).cast("int")), lambda k: F.struct((k * PIECE).alias("o"), F.substring(run, k * PIECE + 1, F.lit(PIECE + WINDOW - 1)).alias("p")))
    found = F.transform(pieces, lambda p: piece_scan(p["o"], p["p"]))
    return let(found, lambda x: F.struct(F.array_min(F.transform(x, lambda y: y["lo"])).alias("lo"), F.array_max(F.transform(x, lambda y: y["hi"])).alias("hi")))


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `base_spans` and `entropy_spans` (arrays of start, kind, end) to the rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(matches(body, ASSIGN, 0, value_group=2), matches(body, ACCESS, 1), matches(body, HEX, 2)))
    out = df.withColumn("base_spans", base).withColumn("__runs", matches(body, CANDIDATE, 3))
    free = F.filter("__runs", lambda r: ~F.exists("base_spans", lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])))
    found = F.transform(free, lambda r: F.struct(r["start"].alias("start"), F.substring(body, r["start"] + 1, r["end"] - r["start"]).alias("run")))
    found = F.filter(found, lambda r: ~r["run"].rlike(ALLOWED))
    tested = F.transform(found, lambda r: F.struct(r["start"].alias("start"), high_entropy(r["run"]).alias("w")))
    spans = F.transform(F.filter(tested, lambda t: t["w"]["lo"].isNotNull()), lambda t: F.struct((t["start"] + t["w"]["lo"]).alias("start"), F.lit(3).alias("kind"), (t["start"] + t["w"]["hi"]).alias("end")))
    return out.withColumn("entropy_spans", F.when(F.size("__runs") > 0, spans).otherwise(F.array().cast(SPAN))).drop("__runs")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every reported span of the text replaced by `mask`; overlapping spans make one."""
    rows = scanned(df, text)
    spans = F.array_sort(F.concat("base_spans", "entropy_spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        kept = F.substring(F.col(text), s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        parts = F.when(x["start"] >= s["at"], F.concat(s["parts"], F.array(kept, F.lit(mask)))).otherwise(s["parts"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), parts.alias("parts"))

    done = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))))
    clean = F.when(F.size(spans) > 0, done).otherwise(F.col(text))
    return rows.withColumn(text, clean).drop("base_spans", "entropy_spans")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by base kind, a digest of the base spans, and all spans."""
    rows = scanned(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "text")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base_spans", "entropy_spans"))).alias("spans"),
    )


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
