"""Joins, keys, upserts and imports on tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import checkpointed


def first_match(left: DataFrame, right: DataFrame, on: str, order: Sequence[Column]) -> DataFrame:
    """Left join that never multiplies rows: of several right rows of a key the first in `order` is used."""
    place = F.row_number().over(Window.partitionBy(on).orderBy(*order))
    first = right.withColumn("__place", place).filter("__place = 1").drop("__place")
    return left.join(first, on, "left")


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group in `order`, with their place if `rank` names a column for it."""
    out = df.withColumn(rank or "__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank or "__place") <= n)
    return out if rank else out.drop("__place")


def deduplicated(new: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """New rows whose key is not known yet, the first of each key in input order."""
    return first_of_group(new.filter(F.col(key).isNotNull()), [key], [F.col(order)]).join(known.select(key).distinct(), key, "left_anti")


def assigned_ids(new: DataFrame, order: str, highest: int, prefix: str = "C") -> DataFrame:
    """Ids prefix%04d after the highest ever given, in input order.

    The rows' places in a range sort are written once, with their partition, and
    numbered by what partitions before hold: no window over all rows, and no
    second run that could part them otherwise. One count a partition is all that
    reaches the driver.
    """
    return numbered(new, order, "__number").withColumn("id", F.format_string(f"{prefix}%04d", F.col("__number") + highest)).drop("__number")


def numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Rows with their place (from 1) in the order of a column; equal ones in any order."""
    place = F.monotonically_increasing_id()  # partition in the high bits, place in it in the low 33
    ranged = checkpointed(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__at", place))
    part = F.shiftrightunsigned("__at", 33)
    total, before = 0, []
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r["part"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "__part long, __before long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + inside + 1).select(*df.columns, out)


def tolerant(columns: Sequence[str], wanted: str) -> str | None:
    """The column of that name, or else the first that agrees in its letters and digits."""
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    return wanted if wanted in columns else next((c for c in columns if plain(c) == plain(wanted)), None)


def percentages(df: DataFrame, column: str, out: str) -> DataFrame:
    """A text column of numbers and percentages as shares: if any cell has a percent sign or exceeds 1, all are divided by 100."""
    cleaned = F.expr(f"try_cast(regexp_replace(`{column}`, '[^0-9eE+.-]', '') as double)")
    scale = df.agg(F.coalesce(F.bool_or(F.col(column).contains("%")) | (F.max(cleaned) > 1), F.lit(False)).alias("__percent"))
    return df.crossJoin(F.broadcast(scale)).withColumn(out, F.when(F.col("__percent"), cleaned / 100).otherwise(cleaned)).drop("__percent")


def ratio(text: Column) -> Column:
    """'k/n' as k/n; null if malformed or n is 0."""
    parts = F.split(text, "/")
    k, n = (F.try_element_at(parts, F.lit(i)) for i in (1, 2))
    value = F.try_divide(k.try_cast("double"), F.nullif(n.try_cast("double"), F.lit(0.0)))
    return F.when(F.size(parts) == 2, value)


def imported(df: DataFrame, id_col: str, column_map: Mapping[str, str], source: str, date: str) -> DataFrame:
    """An external wide table as rows of id, property, value (text), source, import_date; names are matched tolerantly."""
    found = {p: tolerant(df.columns, c) for p, c in column_map.items()}
    if missing := [p for p, c in found.items() if c is None]:
        raise ValueError(f"no column for {missing}")
    long = df.unpivot(id_col, [F.col(f"`{c}`").cast("string").alias(p) for p, c in found.items()], "property", "value")
    return long.filter(F.col("value").isNotNull()).select(id_col, "property", "value", F.lit(source).alias("source"), F.lit(date).cast("date").alias("import_date"))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], touched: DataFrame | None = None) -> DataFrame:
    """Old rows without those whose key was touched, and the new rows.

    `touched` defaults to the new rows' keys; giving it lets a recomputed slot
    that is now empty vanish. New columns are null in old rows; a missing column
    or a changed type (integers and doubles agree, void agrees with all) is an
    error.
    """
    types, fresh = dict(old.dtypes), dict(new.dtypes)
    numbers = {"int", "bigint", "double", "float"}
    for c, t in types.items():
        if c not in fresh:
            raise ValueError(f"column {c!r} is gone")
        if t != fresh[c] and "void" not in (t, fresh[c]) and not {t, fresh[c]} <= numbers:
            raise ValueError(f"column {c!r} was {t} and is {fresh[c]}")
    gone = (touched if touched is not None else new).select(*keys).distinct()
    return old.join(gone, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def proteome_filtered(edges: DataFrame, target: str, proteome: DataFrame, label: str | None = None) -> DataFrame:
    """Edges whose target is listed, with the list's label (a hash of its sorted ids unless given) and size."""
    ids = proteome.select(F.col(target)).filter(F.col(target).isNotNull()).distinct()
    # An order-free digest: the number of ids and the sum of their 64-bit hashes, so that no list is gathered in one row.
    info = ids.agg(F.count("*").alias("n_proteome"), F.coalesce(F.sum(F.xxhash64(F.col(target).cast("string")).cast("decimal(38,0)")), F.lit(0)).alias("__digest"))
    name = F.lit(label) if label else F.concat_ws("_", F.lit("set"), "n_proteome", F.abs("__digest").cast("string"))
    return edges.join(ids, target, "left_semi").crossJoin(F.broadcast(info)).withColumn("proteome_label", name).drop("__digest")


def exported_smiles(df: DataFrame, id_col: str, name: str, canonical: str, raw: str) -> DataFrame:
    """The rows that have a structure, the canonical one first, numbered by id."""
    text = F.coalesce(F.nullif(F.trim(F.col(canonical)), F.lit("")), F.nullif(F.trim(F.col(raw)), F.lit("")))
    return numbered(df.withColumn("smiles", text).filter("smiles is not null").select(id_col, name, "smiles"), id_col, "row_order").select("row_order", id_col, name, "smiles")


def positional(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Left rows with the right row of the same place, both in the order of a column; what the shorter side lacks is null."""
    a = numbered(left, left_order, "row_order")
    b = numbered(right, right_order, "row_order")
    return a.join(b, "row_order", "full")


def matched_by_name(left: DataFrame, name: str, right: DataFrame, other: str) -> DataFrame:
    """Inner join of names that agree but for case and outer white space."""
    key = lambda c: F.lower(F.trim(F.col(c)))
    return left.withColumn("__name", key(name)).join(right.withColumn("__name", key(other)), "__name").drop("__name")


def single_row(df: DataFrame) -> DataFrame:
    """The table, if it has exactly one row; an error otherwise."""
    n = df.limit(2).count()
    if n != 1:
        raise ValueError("no row" if not n else "more than one row")
    return df


def matched_import(df: DataFrame, compounds: DataFrame, order: Sequence[str] = ("compound", "smiles")) -> DataFrame:
    """Imported rows with the compound that they are of, by the keys in `order`, the first that matches; others go.

    compounds: compound, smiles. Descriptor tables match by id, then structure;
    toxicity tables the other way round.
    """
    known = {c: first_of_group(compounds.filter(F.col(c).isNotNull()), [c], [F.col("compound")]).select(F.col(c).cast("string").alias(f"__key_{c}"), F.col("compound").alias(f"__by_{c}")) for c in order}
    out = df
    for c in order:
        text = F.trim(F.col(c).cast("string")) if c in df.columns else F.lit(None).cast("string")
        out = out.withColumn(f"__key_{c}", text).join(known[c], f"__key_{c}", "left")
    found = F.coalesce(*[F.col(f"__by_{c}") for c in order])
    rest = [c for c in df.columns if c != "compound"]
    return out.withColumn("__found", found).filter("__found is not null").select(F.col("__found").alias("compound"), *rest)


def prepared(new: DataFrame, known: DataFrame, order: str, highest: int, missing: str = "drop") -> DataFrame:
    """New compounds (name, smiles) with ids: blank structures dropped (or an error if `missing` is "abort"), one row for each structure that is not known yet.

    known: smiles. Structures are compared as trimmed text; a canonical form is the caller's.
    """
    if missing not in ("drop", "abort"):
        raise ValueError(f"unknown policy {missing!r}")
    text = F.nullif(F.trim("smiles"), F.lit(""))
    rows = new.withColumn("smiles", text)
    if missing == "abort" and not rows.filter("smiles is null").isEmpty():
        raise ValueError("rows without a structure")
    return assigned_ids(deduplicated(rows, known.withColumn("smiles", text), "smiles", order), order, highest)


def gene_list(df: DataFrame, disease_id: str, disease_name: str, source: str, accession: str = "Uniprot ID", symbol: str = "Gene Symbol", score: str = "Relevance score") -> DataFrame:
    """A curated gene list as associations: columns are found tolerantly, blank and "na" accessions go, the rest is distinct."""
    a, s, v = (tolerant(df.columns, c) for c in (accession, symbol, score))
    if a is None:
        raise ValueError(f"no column like {accession!r}; a list of symbols alone needs a mapping first")
    text = lambda c: F.trim(F.col(f"`{c}`").cast("string")) if c else F.lit(None).cast("string")
    rows = df.select(F.lit(disease_id).alias("disease_id"), F.lit(disease_name).alias("disease_name"), text(a).alias("target"), text(s).alias("gene_symbol"), text(v).try_cast("double").alias("association_score"), F.lit(source).alias("source"))
    return rows.filter(F.col("target").isNotNull() & ~F.lower("target").isin("", "na")).distinct()


def bioactivities(rows: DataFrame, denied: Sequence[str]) -> DataFrame:
    """Measured activities (compound, target, target_name, kind, value) without blank targets and denied names (any case), by compound, target, kind and value."""
    named = F.col("target").isNotNull() & (F.trim("target") != "") & ~F.lower(F.trim(F.coalesce("target_name", F.lit("")))).isin(*[d.lower() for d in denied])
    return rows.filter(named).orderBy(*[F.asc_nulls_last(c) for c in ("compound", "target", "kind", "value")])


def classes_upserted(old: DataFrame, asked: DataFrame, labels: DataFrame) -> DataFrame:
    """External class labels of the asked compounds (null where none is known), in place of what these had."""
    return upserted(old, asked.select("compound").distinct().join(labels, "compound", "left").select(old.columns), ["compound"])


def best_symbols(associations: DataFrame) -> DataFrame:
    """One gene symbol for each target: that of the highest score."""
    return first_of_group(associations, ["target"], [F.desc_nulls_last("score"), F.col("gene_symbol")])


LOG = T.StructType([T.StructField("step", T.StringType()), T.StructField("id", T.StringType()), T.StructField("message", T.StringType()), T.StructField("timestamp", T.TimestampType())])
