"""Readers: delimited files with explicit schemas, prediction batches, pathway XML, paged JSON, and interaction files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import percentages, tolerant


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """A file or folder with a header; without a schema all columns are text, so that ids such as 007 survive."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def predictions(spark: SparkSession, path: str, target: str = "UniProt ID", probability: str = "Probability", confidence: str | None = "Model accuracy") -> DataFrame:
    """Prediction files of a folder: the compound's number is the first run of digits in the file's name; shares may be in percent."""
    raw = csv(spark, path).withColumn("__file", F.regexp_extract("_metadata.file_name", r"(\d+)", 1))
    t, p = tolerant(raw.columns, target), tolerant(raw.columns, probability)
    if t is None or p is None:
        raise ValueError(f"no column like {target!r} or {probability!r} among {raw.columns}")
    c = tolerant(raw.columns, confidence) if confidence else None
    rows = raw.select(F.nullif("__file", F.lit("")).alias("compound"), F.trim(F.col(f"`{t}`")).alias("target"), F.col(f"`{p}`").alias("__p"), (F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias("__c"))
    out = percentages(percentages(rows, "__p", "probability"), "__c", "confidence")
    return out.filter("target is not null and target <> ''").select("compound", "target", "probability", "confidence")


def prediction_log(spark: SparkSession, path: str, compounds: DataFrame) -> DataFrame:
    """One row per file of a folder: its name, compound, rows, and whether the compound is known."""
    rows = csv(spark, path).groupBy(F.col("_metadata.file_name").alias("path")).agg(F.count("*").alias("rows"))
    # Files without rows are listed too.
    every = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("path"))
    files = every.join(rows, "path", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    number = F.nullif(F.regexp_extract("path", r"(\d+)", 1), F.lit(""))
    known = compounds.select(F.col("compound").cast("string").alias("compound")).distinct().withColumn("known", F.lit(True))
    out = files.withColumn("compound", number).join(known, "compound", "left")
    reason = F.when(F.col("compound").isNull(), "no id in the file's name").when(F.col("known").isNull(), "unknown compound").when(F.col("rows") == 0, "no rows").otherwise("imported")
    return out.select("path", "compound", "rows", (F.coalesce("known", F.lit(False)) & (F.col("rows") > 0)).alias("ok"), reason.alias("reason"))


def pathway_relations(spark: SparkSession, path: str) -> DataFrame:
    """Relations of pathway XML files: every subtype of every relation between all genes of both boxes; a group is all its members.

    Columns pathway, title, source, sink, relation_type, subtype, value.
    """
    text = spark.read.text(path, wholetext=True)
    schema = (
        "struct<_name:string,_title:string,"
        "entry:array<struct<_id:string,_name:string,_type:string,component:array<struct<_id:string>>>>,"
        "relation:array<struct<_entry1:string,_entry2:string,_type:string,subtype:array<struct<_name:string,_value:string>>>>>"
    )
    doc = text.select(F.from_xml("value", schema, {"rowTag": "pathway"}).alias("p"))
    entries = doc.select(F.col("p._name").alias("pathway"), F.explode("p.entry").alias("e"))
    genes = entries.filter("e._type = 'gene'").select("pathway", F.col("e._id").alias("entry"), F.explode(F.split(F.trim("e._name"), r"\s+")).alias("gene"))
    parts = entries.filter("e._type = 'group'").select("pathway", F.col("e._id").alias("group"), F.explode("e.component").alias("c")).select("pathway", "group", F.col("c._id").alias("entry"))
    members = genes.unionByName(parts.join(genes, ["pathway", "entry"]).select("pathway", F.col("group").alias("entry"), "gene"))
    rel = doc.select(F.col("p._name").alias("pathway"), F.col("p._title").alias("title"), F.explode("p.relation").alias("r")).select("pathway", "title", F.col("r._entry1").alias("a"), F.col("r._entry2").alias("b"), F.col("r._type").alias("relation_type"), F.explode_outer("r.subtype").alias("s"))
    left, right = members.select("pathway", F.col("entry").alias("a"), F.col("gene").alias("source")), members.select("pathway", F.col("entry").alias("b"), F.col("gene").alias("sink"))
    return rel.join(left, ["pathway", "a"]).join(right, ["pathway", "b"]).select("pathway", "title", "source", "sink", "relation_type", F.col("s._name").alias("subtype"), F.col("s._value").alias("value")).distinct()


def associations(spark: SparkSession, path: str, min_score: float = 0.4) -> DataFrame:
    """Disease-to-target pages in JSON lines ({disease: {id, name}, rows: [{target: {symbol, proteins: [{id, source}]}, score}]}): reviewed accessions, scores of at least `min_score`."""
    schema = "disease struct<id:string,name:string>, rows array<struct<target:struct<symbol:string,proteins:array<struct<id:string,source:string>>>,score:double>>"
    rows = spark.read.schema(schema).json(path).select("disease", F.explode("rows").alias("r")).filter(F.col("r.score") >= min_score)
    each = rows.select("disease", "r", F.explode("r.target.proteins").alias("p")).filter("p.source = 'uniprot_swissprot'")
    return each.select(F.col("disease.id").alias("disease_id"), F.col("disease.name").alias("disease_name"), F.col("p.id").alias("target"), F.col("r.target.symbol").alias("gene_symbol"), F.col("r.score").alias("association_score")).distinct()


def links(spark: SparkSession, path: str, least: int) -> DataFrame:
    """A space-separated link file: pairs in canonical order with a combined score of at least `least`; the filter reaches the scan."""
    return csv(spark, path, "protein1 string, protein2 string, combined_score int", sep=" ").filter((F.col("combined_score") >= least) & (F.col("protein1") < F.col("protein2")))


def actions(spark: SparkSession, path: str, least: int) -> DataFrame:
    """A tab-separated action file: directed edges whose first side acts. Flags may be t, true or 1. No edge at all is an error."""
    true = lambda c: F.lower(F.trim(F.col(c))).isin("t", "true", "1")
    raw = csv(spark, path, sep="\t")
    out = raw.filter(true("is_directional") & true("a_is_acting") & (F.col("score").try_cast("int") >= least)).select(F.col("item_id_a").alias("u"), F.col("item_id_b").alias("v")).distinct()
    if out.isEmpty():
        raise ValueError("no directed edge in the file")
    return out


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """protein, alias, source from a file in tabs, or, where a line has none, in spaces; its header is either names or a comment."""
    text = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.when(F.col("value").contains("\t"), F.split("value", r"\t")).otherwise(F.split(F.trim("value"), r" +", 3))
    return text.select(parts[0].alias("protein"), F.try_element_at(parts, F.lit(2)).alias("alias"), F.try_element_at(parts, F.lit(3)).alias("source")).filter("alias is not null and lower(alias) <> 'alias'")
