"""Keyed updates of result tables, and which sources a run has to look at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    """New rows replace those of their key; all others stay. Columns that one side lacks are null. Of several new
    rows of one key, callers keep one first (latest())."""
    keys = [key] if isinstance(key, str) else key
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def unprocessed(source: DataFrame, results: DataFrame, key: str = "src", retry_unmatched: bool = False) -> DataFrame:
    """Sources without any result; with retry_unmatched also those whose result is none."""
    done = results.filter(F.col("match_type") != "none") if retry_unmatched else results
    return source.join(done.select(key).distinct(), key, "left_anti")


def decisions(new: DataFrame, existing: DataFrame, key: str, target: str, score: str) -> DataFrame:
    """What a run does with each new result: matched (there was none), skipped (same target, no better score), updated."""
    old = existing.select(F.col(key).alias("__key"), F.col(target).alias("__target"), F.col(score).alias("__score"))
    joined = new.join(old, F.col(key) == F.col("__key"), "left")
    same = F.col("__target").eqNullSafe(F.col(target)) & (F.col(score) <= F.col("__score"))
    decision = F.when(F.col("__key").isNull(), "matched").when(same, "skipped").otherwise("updated")
    return joined.withColumn("decision", decision).drop("__key", "__target", "__score")


def backfilled(rows: DataFrame, lookup: DataFrame, key: tuple[str, str], column: tuple[str, str]) -> DataFrame:
    """Empty values of a column filled from a lookup table of one row per key."""
    side = lookup.select(F.col(key[1]).alias("__key"), F.col(column[1]).alias("__value"))
    own = F.col(column[0])
    return rows.join(side, F.col(key[0]) == F.col("__key"), "left").withColumn(column[0], F.coalesce(F.when(F.trim(own.cast("string")) != "", own), F.col("__value"))).drop("__key", "__value")


def cleaned(tasks: DataFrame, now: Column, days: int, abnormal: list[str]) -> DataFrame:
    """Task rows that stay: young enough and in no abnormal state."""
    return tasks.filter((F.col("created_at") >= now - F.expr(f"interval {days} days")) & ~F.col("status").isin(*abnormal))


def deleted(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, how many go): a delete as filter-and-rewrite, with its preview."""
    hit = F.coalesce(condition, F.lit(False))
    return rows.filter(~hit), rows.filter(hit).agg(F.count("*").alias("deleted"))
