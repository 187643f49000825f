"""The pipeline's stages on a small corpus with planted cases."""

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm.classify import quality_model, score_quality
from weftgraph.llm.common import flagged, persisted
from weftgraph.llm.subword import Shape, bag, train

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.orderBy(F.desc("n_chars")).first()
    extra = [(90_001, None, "en", "s", 0), (90_002, "12 34 !!", "en", "s", 8), (90_003, clean.text, "en", "s", clean.n_chars), (90_004, f"{clean.text} password: hunter2x", "en", "s", 0)]
    d = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("score", F.lit(1))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = persisted(stage(spark, d, SF))
        assert d.columns == [*docs.columns, "score"]
        kept[name] = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    assert 90_001 not in kept["language_id"] and 90_002 not in kept["language_id"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in kept["language_id"] if labels.get(i) == 1]
    assert sum(i in kept["quality"] for i in good) >= 0.98 * len(good)
    assert 90_003 not in kept["near_dedup"] and 90_004 not in kept["near_dedup"]
    assert set(kept["secrets"]) == set(kept["near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, d, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["secrets"])
    assert P.path("byte_bpe_50k.json")


def test_run_over_the_table(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_quality_drops_what_the_classifier_predicts_to_be_bad(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = docs.join(labels.filter("quality is not null"), "doc_id").filter("n_chars > 400").select("text", "quality").orderBy("doc_id").collect()
    fine, poor = ([r.text.split() for r in known if r.quality == q][:6] for q in (1, 0))
    texts = [" ".join(a[: 2 * n] + b[: 2 * (20 - n)]) for a in fine for b in poor for n in range(21)]
    planted = docs.unionByName(spark.createDataFrame([(90_000 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], docs.schema))
    model = quality_model(planted, labels, F.lit(True))
    score = {r.doc_id: r.score for r in score_quality(planted, model).collect()}
    kept = {r.doc_id for r in corpus_pipeline.good(spark, planted, SF).collect()}
    assert any(0.3 <= s < 0.5 for s in score.values())
    assert kept == {i for i, s in score.items() if s >= 0.5}


def test_stages_of_nothing_and_of_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    none = docs.limit(0)
    named = docs.limit(40).withColumn("keep0", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("component", F.lit(1)).withColumn("spans", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none, named = persisted(stage(spark, none, SF)), persisted(stage(spark, named, SF))
        assert none.count() == 0 and none.columns == docs.columns and named.columns == [*docs.columns, "keep0", "rep", "component", "spans"]
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_near_dedup_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "one text of some words here"), (1, "quite another text with more words"), (2, "one text of some words here"), (2, "one text of some words here"), (None, "x y")], "doc_id long, text string")
    got = corpus_pipeline.deduplicated(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "x y"), (1, "one text of some words here"), (1, "quite another text with more words")]


def test_scoring_holds_few_words_at_once_and_leaves_no_cache(spark):
    rows = spark.range(0, 3000, numPartitions=1).select(F.concat_ws(" ", F.lit("word"), F.col("id")).alias("text"))
    sizes = rows.select(flagged(F.col("text"), lambda texts, _: [len(texts) <= 512] * len(texts), lambda: None).alias("few"))
    assert sizes.filter("few").count() == 3000
    model = train([bag(t, Shape()) for t in ("ja oui", "no si")], ["a", "b"], Shape())
    own = model.fresh()
    assert (own.probabilities(["ja si"]) == model.fresh().probabilities(["x", "ja si"])[1:]).all()
    assert own.cache and not model.cache and model.sums is None
