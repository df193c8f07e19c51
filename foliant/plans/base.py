"""Queries over named tables, stated once for Spark and for the checking engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from foliant.functions.dialect import DUCK, SPARK, Dialect
from foliant.operators.steps import Step, chain, run_steps

__all__ = ["Query", "Stated", "Steps", "chain", "run"]


def run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over the given DataFrames under their names."""
    return run_steps(spark, [], sql, tables)


def _read(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}


@dataclass(frozen=True)
class Query:
    """A registered query; ``sql`` writes it for a dialect over the driver's tables."""

    sql: Callable[[Dialect], str]
    tables: tuple[str, ...]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, self.sql(SPARK), **_read(spark, sf_dir, self.tables))

    def oracle(self) -> str:
        return self.sql(DUCK)


@dataclass(frozen=True)
class Steps:
    """A registered query of named steps. On Spark, the steps in ``keep`` are written once for all their readers."""

    steps: Callable[[Dialect], list[Step]]
    last: Callable[[Dialect], str]
    tables: tuple[str, ...]
    keep: tuple[str, ...] = ()

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.over(spark, **_read(spark, sf_dir, self.tables))

    def over(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        return run_steps(spark, self.steps(SPARK), self.last(SPARK), tables, self.keep)

    def oracle(self) -> str:
        return chain(self.steps(DUCK), self.last(DUCK))


@dataclass(frozen=True)
class Stated:
    """A call over the driver's tables, and the SQL that says what it gives."""

    call: Callable[..., DataFrame]
    sql: str
    tables: tuple[str, ...]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.call(**_read(spark, sf_dir, self.tables))

    def oracle(self) -> str:
        return self.sql
