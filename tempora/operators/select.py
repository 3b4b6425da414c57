"""Greedy choices, budgets and ranks within a recording.

The greedy operators fold over one array of candidates per recording, in the order of their score; candidates are few
(one per sentence or loud moment at most), and the fold keeps only what it chose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _greedy(rows: DataFrame, key: list[Column], clashes: Callable[[Column, Column], Column], limit: int) -> DataFrame:
    """Rows in the order of key, each kept unless it clashes with one kept before, at most ``limit`` per rec_id."""
    own = F.struct(*[F.col(c) for c in rows.columns])
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("rec_id").orderBy(*key)))
    per = ranked.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("_rank", own.alias("x")))).alias("all"))
    seed = F.filter("all", lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        free = (F.size(kept) < limit) & ~F.exists(kept, lambda o: clashes(x["x"], o["x"]))
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    return per.select(F.explode(F.aggregate("all", seed, step)).alias("k")).select("k.x.*")


def greedy_ranges(rows: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Highest score first (then the first range); inclusive ranges first..last never share a sentence."""
    return _greedy(rows, [F.desc("score"), F.col("first"), F.col("last")], lambda x, o: (x["first"] <= o["last"]) & (o["first"] <= x["last"]), limit)


def greedy_padded(rows: DataFrame, limit: int, after: float = 12.0, before: float = 20.0) -> DataFrame:
    """Highest score first; stretches keep ``after`` seconds behind and ``before`` seconds ahead of each other."""
    return _greedy(rows, [F.desc("score"), F.col("idx")], lambda x, o: (x["start"] < o["end"] + after) & (o["start"] - before < x["end"]), limit)


def greedy_spaced(rows: DataFrame, apart: float, limit: int) -> DataFrame:
    """Highest score first, of equal scores the later; beginnings are at least ``apart``."""
    return _greedy(rows, [F.desc("score"), F.desc("first"), F.desc("last")], lambda x, o: F.abs(x["first"] - o["first"]) < apart, limit)


def within_budget(rows: DataFrame, budget: float) -> DataFrame:
    """What is left when the lowest scores (of equal ones the first) go until the lengths fit the budget."""
    w = Window.partitionBy("rec_id").orderBy("score", "idx").rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("_sum", F.sum(F.col("end") - F.col("start")).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def rescaled(rows: DataFrame, low: float = 50.0, span: float = 30.0, even: float = 60.0) -> DataFrame:
    """Scores stretched to low..low + span within a recording, to one decimal; all equal give ``even``."""
    w = Window.partitionBy("rec_id")
    top, bottom = F.max("score").over(w), F.min("score").over(w)
    return rows.withColumn("_t", top).withColumn("_b", bottom).withColumn("score", F.when(F.col("_t") > F.col("_b"), F.round(low + span * (F.col("score") - F.col("_b")) / (F.col("_t") - F.col("_b")), 1)).otherwise(even)).drop("_t", "_b")


def newest(rows: DataFrame, by: str, at: str, limit: int, tie: str) -> DataFrame:
    """The newest ``limit`` rows of each key; rows without a time come last."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(at), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def wanted_count(clips: int, fixed: int = 0) -> int:
    """How many stretches to look at for so many clips."""
    return fixed if fixed > 0 else min(24, max(5, round(clips * 1.5) + 2))
