"""Counts over catalogue sheets: categories, crosstabs, yearly trends, multi-label counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_counts(df: DataFrame, category: str, share: float = 0.0) -> DataFrame:
    """Rows per category; categories with one row, or at most this share of all rows, are summed as Other."""
    n = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    tail = F.greatest(F.lit(1.0), n.agg(F.sum("n")).scalar() * F.lit(share))
    return n.groupBy(F.when(F.col("n") <= tail, "Other").otherwise(F.col(category)).alias(category)).agg(F.sum("n").alias("n"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Rows x named columns of counts, zero where a combination does not occur."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).fillna(0, list(values))


def label_counts(df: DataFrame, labels: Column, name: str = "label") -> DataFrame:
    """Rows per label of an array column; a row counts once for every label it has."""
    return df.select(F.explode(labels).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def yearly_trend(df: DataFrame, year: str, groups: dict[str, Column]) -> DataFrame:
    """Rows per year and group, zero-filled over all years; groups are predicates that may overlap."""
    n = df.groupBy(F.col(year).alias("year")).agg(*[F.count_if(cond).alias(f"g{i}") for i, cond in enumerate(groups.values())])
    span = n.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    years = span.select(F.explode(F.sequence("lo", "hi")).alias("year"))
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("grp"), F.coalesce(F.col(f"g{i}"), F.lit(0)).alias("n")) for i, name in enumerate(groups)]))
    return years.join(n, "year", "left").select("year", rows.alias("_r")).select("year", "_r.*")
