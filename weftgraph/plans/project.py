"""An immutable project: named tables, parameters and an append-only log. Steps return a new project."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.tables import LOG, upserted
from ..sources.writers import swapped


@dataclass(frozen=True)
class Project:
    spark: SparkSession
    path: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    log: tuple[tuple[str, str | None, str, datetime], ...] = ()

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; run the step that makes it first")
        return self.tables[name]

    def with_table(self, name: str, df: DataFrame, step: str = "", message: str = "", now: datetime | None = None) -> Project:
        entry = (step or name, None, message, now or datetime.now(UTC).replace(tzinfo=None))
        return replace(self, tables=self.tables | {name: df}, log=(*self.log, entry))

    def upsert(self, name: str, df: DataFrame, keys: list[str], touched: DataFrame | None = None) -> Project:
        old = self.tables.get(name)
        return self.with_table(name, df if old is None else upserted(old, df, keys, touched), "upsert", name)

    def log_table(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.log), LOG)

    def save(self) -> None:
        for name, df in self.tables.items():
            swapped(df, f"{self.path}/results/{name}")
        swapped(self.log_table(), f"{self.path}/log")

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: list[str]) -> Project:
        log = tuple(tuple(r) for r in spark.read.schema(LOG).parquet(f"{path}/log").collect())
        return cls(spark, path, {n: spark.read.parquet(f"{path}/results/{n}") for n in names}, log)
