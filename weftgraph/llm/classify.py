"""Language identification and quality scores by averaged hashed subword embeddings.

Both fit one model on a bounded sample of labelled rows, chosen by a hash of
the id. The sample's hashed bags (not its texts) meet in one task, which trains
and hands the driver nothing but the model: one row of class scores a bucket,
whatever the input. That is broadcast, and every whole text is scored in one
Arrow map without a shuffle.

Null and empty texts have no features: they get the classes' prior scores (and,
for languages, the label `und` with score 0, as every text without a letter).
Without any labelled training row, languages are `und` with score 0 and quality
scores are 0.5. Rows with a null label or a null id are not learned from (a null
id counts as held out). More than MOST_LABELS labels are an error. Repeated rows
give repeated results, an empty table an empty one, other columns are ignored.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_rows, released, table
from .subword import Model, Shape, bag, train

#: Bounds of the training samples: rows of each language, labelled rows for quality, and features (distinct buckets of a text) in all.
ROWS_PER_LANGUAGE = 1200
ROWS_FOR_QUALITY = 5000
MOST_FEATURES = 40_000_000
#: More labels than this are dirty data rather than classes.
MOST_LABELS = 1000
#: Steps of a draw by hash: fine enough for a share of one row in a million million.
DRAWS = 1 << 42
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")

LANGUAGE_SHAPE = Shape(lower=True)
QUALITY_SHAPE = Shape(lower=False, repeats=True, prior=100)


def sampled(rows: DataFrame, label: str, most: int, key: str) -> tuple[DataFrame, int]:
    """About `most` rows of each label at most, chosen by a hash of `key` (the share is set by the labels' counts), and the number of labels."""
    counts = rows.groupBy(label).count().limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} values of {label}")
    if not counts:
        return rows.limit(0), 0
    shares = F.create_map(*[F.lit(x) for value, n in counts for x in (value, int(min(1.0, most / n) * DRAWS))])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(DRAWS))
    return rows.filter(draw < shares[F.col(label)]), len(counts)


def fitted(rows: DataFrame, shape: Shape, most: int) -> Model:
    """A model from rows of `text` and `label` (a string), of which at most `most` are taken; it is trained in one task."""

    def kernel(part: dict[str, list]) -> dict[str, list]:
        bags = [bag(t or "", shape) for t in part["text"]]
        return {"label": part["label"], "at": [a.astype(a.dtype.newbyteorder("<")).tobytes() for a, _ in bags], "share": [w.astype("<f4").tobytes() for _, w in bags], "row": [hash_of(a, w) for a, w in bags]}

    def trained(found: pa.Table) -> pa.Table:
        # The order of rows must not depend on tasks; by a hash, it is no order of the corpus either. Equal hashes and labels are equal rows.
        hashes, labels = found.column("row").to_pylist(), found.column("label").to_pylist()
        order, left, kept = sorted(range(len(labels)), key=lambda i: (hashes[i], labels[i])), MOST_FEATURES, []
        # Bags stay where Arrow has them: views, not copies.
        at, share = ([np.frombuffer(x.as_buffer(), kind) for x in found.column(c)] for c, kind in (("at", "<u2" if shape.bits <= 16 else "<u4"), ("share", "<f4")))
        for i in order:
            left -= len(at[i])
            if kept and left < 0:
                break
            kept.append(i)
        model = train([(at[i], share[i]) for i in kept], [labels[i] for i in kept], shape)
        del found, at, share
        released()
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    bags = map_rows(rows.select("text", F.col("label").cast("string").alias("label")), kernel, "label string, at binary, share binary, row bigint").limit(most)
    found = bags.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(trained, "model binary").first()
    return pickle.loads(found.model) if found else train([], [], shape)


def hash_of(at: np.ndarray, share: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(at.tobytes() + share.tobytes()) >> 1


def language_model(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    known = docs.filter(learn & F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    few, labels = sampled(known.select(F.col(doc_id).alias("key"), F.col(text).alias("text"), F.col(lang).alias("label")), "label", rows, "key")
    return fitted(few, LANGUAGE_SHAPE, 2 * rows * max(1, labels))


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: `lang_pred`, its calibrated `score`, and whether the model would reject it."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(rows: dict[str, list], m: Model) -> dict[str, list]:
        texts = [t or "" for t in rows["text"]]
        n = len(texts)
        p = m.probabilities(texts) if m.classes else np.zeros((n, 1))
        names, best = (m.classes or [UNKNOWN]), p.argmax(axis=1)
        seen = [bool(m.classes) and LETTER.search(t) is not None for t in texts]
        score = [float(p[i, best[i]]) if seen[i] else 0.0 for i in range(n)]
        return {"doc_id": rows["doc_id"], "lang_pred": [names[best[i]] if seen[i] else UNKNOWN for i in range(n)], "score": score, "rejected": [s < m.reject_below or not ok for s, ok in zip(score, seen, strict=True)]}

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(source, kernel, "doc_id bigint, lang_pred string, score double, rejected boolean", setup=lambda: held.value.fresh())


def quality_model(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS_FOR_QUALITY) -> Model:
    """Fit on documents whose id has a label; an id with several labels has the largest."""
    known = labels.filter(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("key")).agg(F.max(label).alias("label"))
    few = sampled(known, "label", rows // 2, "key")[0].limit(2 * rows)
    source = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(few), "key")
    return fitted(source, QUALITY_SHAPE, 2 * rows)


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the probability of label 1 and the label it predicts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(rows: dict[str, list], m: Model) -> dict[str, list]:
        texts = [t or "" for t in rows["text"]]
        if "1" in m.classes:
            score = m.probabilities(texts)[:, m.classes.index("1")]
        else:
            score = np.full(len(texts), 0.0 if m.classes else 0.5)
        return {"doc_id": rows["doc_id"], "score": score.tolist(), "predicted": [int(s >= 0.5) for s in score]}

    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(source, kernel, "doc_id bigint, score double, predicted int", setup=lambda: held.value.fresh())


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5)
    found = identify(docs, language_model(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels, held = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out(F.col("doc_id"), 3, 1)
    found = score_quality(docs, quality_model(docs, labels, ~held))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")
