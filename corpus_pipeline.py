"""A corpus pipeline of five stages over the documents table, each a training-data operator whose decisions take effect.

Language ID drops what it rejects, the quality classifier drops what it
predicts to be bad, near-dedup keeps one document of each group, the secret
scan masks what it finds, and packing returns the pieces with their sequences.
A null text is rejected by the first stage. Every stage but the last returns
the columns of its input, in order; extra columns ride along, whatever their
names. A null id is kept by near-dedup, as no document is known to be its copy.
An empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.classify import LETTER, language_model, quality_model
from weftgraph.llm.common import flagged, persisted, table
from weftgraph.llm.near_dup import components
from weftgraph.llm.packing import pack
from weftgraph.llm.secrets import redacted

#: Scores are calibrated probabilities of being good; below this the classifier (op8) predicts label 0, and the document goes.
BAD_BELOW = 0.5
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the model does not reject: those with a letter and a score over the calibrated bound."""
    held = spark.sparkContext.broadcast(language_model(docs, F.lit(True)))

    def judge(texts: list, m) -> list:
        texts = [t or "" for t in texts]
        score = m.probabilities(texts).max(axis=1).tolist() if m.classes else [1.0] * len(texts)
        return [LETTER.search(t) is not None and s >= m.reject_below for t, s in zip(texts, score, strict=True)]

    return docs.filter(flagged(F.col("text"), judge, lambda: held.value.fresh()))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality model, fitted to all labels, does not take for bad ones."""
    held = spark.sparkContext.broadcast(quality_model(docs, table(spark, sf_dir, "labels"), F.lit(True)))

    def judge(texts: list, m) -> list:
        texts = [t or "" for t in texts]
        score = m.probabilities(texts)[:, m.classes.index("1")].tolist() if "1" in m.classes else [1.0] * len(texts)
        return [s >= BAD_BELOW for s in score]

    return docs.filter(flagged(F.col("text"), judge, lambda: held.value.fresh()))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate component; of rows repeated whole, one."""
    found = components(docs, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    # Only ids are grouped; whole rows meet those that go, and only rows of repeated ids are compared.
    drop = found.filter("not kept").select("doc_id").distinct()
    again = persisted(found.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    left = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return left
    single = left.join(again, "doc_id", "left_anti").select(*docs.columns)
    return single.unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask all secrets in the texts; no document is dropped."""
    return redacted(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 1024."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identified), ("quality", good), ("near_dedup", deduplicated), ("secrets", masked), ("packing", packed)]

#: Trained models and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table; what stages keep is written in between."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
