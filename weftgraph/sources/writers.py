"""Sinks: whole-table writes that readers never see half done, and text reports."""

from __future__ import annotations

import html
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def swapped(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside the target, move the old table aside and the new one into place, through the path's own file system.

    A plan may read what it replaces. One table is whole at every time: after a
    crash between the two moves, it is the one aside, which the next call (or
    `restored`) puts back. Between the moves the path itself is absent for a moment.
    """
    fs, path_of = restored(df.sparkSession, path)
    fresh, aside = path_of(f"{path}.new-{uuid.uuid4().hex}"), path_of(f"{path}.old")
    df.write.format(fmt).option("header", True).save(fresh.toString())
    at = path_of(path)
    if fs.exists(at) and not fs.rename(at, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(fresh, at):
        raise OSError(f"could not move {fresh.toString()} to {path}")
    fs.delete(aside, True)


def restored(spark: SparkSession, path: str):
    """Put back a table that a crash has left aside; returns its file system and a maker of paths."""
    jvm = spark.sparkContext._jvm
    path_of = jvm.org.apache.hadoop.fs.Path
    at, aside = path_of(path), path_of(f"{path}.old")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(at):
            fs.delete(aside, True)
        elif not fs.rename(aside, at):
            raise OSError(f"could not move {path} back")
    return fs, path_of


def digest(tables: dict[str, DataFrame], most: int = 200) -> str:
    """All tables as text, each up to `most` rows, for reading by people or models."""
    out = []
    for name, df in tables.items():
        rows = df.limit(most).toPandas()
        out += [f"## {name}", rows.to_csv(index=False)]
    return "\n".join(out)


def report(spark: SparkSession, condition: str, sections: dict[str, DataFrame | None], top: int = 20) -> str:
    """An HTML page of small tables of one condition; an absent table leaves a note. Numbers have four digits."""
    out = [f"<html><body><h1>{html.escape(condition)}</h1>"]
    for name, df in sections.items():
        out.append(f"<h2>{html.escape(name)}</h2>")
        if df is None:
            out.append("<p>not computed</p>")
            continue
        own = df.filter(F.col("condition") == condition) if "condition" in df.columns else df
        rows = own.limit(top).collect()
        cell = lambda x: "" if x is None else html.escape(f"{x:.4g}" if isinstance(x, float) else str(x))
        out.append("<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in own.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in rows]
        out.append("</table>")
    return "\n".join([*out, "</body></html>"])
