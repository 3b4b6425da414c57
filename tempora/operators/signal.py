"""Levels, loudness and scene scores: thresholds, runs, rolling medians, spikes."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tempora.functions.numbers import between, rounded
from tempora.operators.select import greedy_spaced
from tempora.operators.temporal import islands


def quantiles(series: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, one column for each name of shares): quantiles between the two nearest of the sorted values; n counts the values.

    Values are ranked by a sort that may spill, and only the few that a quantile lies between are gathered.
    """
    w = Window.partitionBy(*by)
    x = series.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.count("*").over(w).alias("n"), (F.row_number().over(w.orderBy(value)) - 1).alias("_r"))
    at = {name: (F.col("n") - 1) * p for name, p in shares.items()}
    pick = lambda place: F.max(F.when(F.col("_r") == place, F.col("_v")))
    near = x.groupBy(*by, "n").agg(*[pick(f(c)).alias(f"_{side}_{name}") for name, c in at.items() for side, f in (("low", F.floor), ("high", F.ceil))])
    lies = lambda name, c: F.when(F.floor(c) == F.ceil(c), F.col(f"_low_{name}")).otherwise(between(F.col(f"_low_{name}"), F.col(f"_high_{name}"), c - F.floor(c)))
    return near.select(*by, "n", *[lies(name, c).alias(name) for name, c in at.items()])


def silences(levels: DataFrame, frame: float = 0.02, min_len: float = 0.25, spread: float = 18.0, below_loud: float = 30.0, above_quiet: float = 6.0) -> DataFrame:
    """(rec_id, first, last, start, end) of quiet runs in levels (rec_id, idx, db); none where the level hardly varies."""
    limits = quantiles(levels, ["rec_id"], "db", {"loud": 0.95, "quiet": 0.10}).drop("n").where(F.col("loud") - F.col("quiet") >= spread)
    flagged = levels.join(limits, "rec_id")
    runs = islands(flagged, F.col("db") < F.greatest(F.col("loud") - below_loud, F.col("quiet") + above_quiet))
    return runs.where((F.col("last") - F.col("first") + 1) * frame >= min_len).select("rec_id", "first", "last", (F.col("first") * frame).alias("start"), ((F.col("last") + 1) * frame).alias("end"))


def loudness(levels: DataFrame, per: int = 50, p: float = 0.9) -> DataFrame:
    """(rec_id, sec, db): how loud each second gets; a last, partial second is dropped."""
    return quantiles(levels.withColumn("sec", F.floor(F.col("idx") / per)), ["rec_id", "sec"], "db", {"_p": p}).where(F.col("n") == per).select("rec_id", "sec", F.col("_p").alias("db"))


def rolling_median(series: DataFrame, half: int | str, order: str = "sec", value: str = "db") -> DataFrame:
    """(rec_id, order, value, around) of a series: the median of 2 * half + 1 values, the first and last value repeated beyond the ends.

    half is a number or a column, the same for all rows of a recording; rows without a value are left out.  Recordings stream
    through tasks in order, and a task holds one window: its values as they came, and the same in order of size, in which
    one is put and one taken out a row.
    """
    wide = series.select("rec_id", order, F.col(value).cast("double").alias(value), (F.col(half) if isinstance(half, str) else F.lit(half)).cast("int").alias("_half")).where(F.col(value).isNotNull())
    out = StructType([*wide.drop("_half").schema.fields, StructField("around", DoubleType())])
    names = [*wide.columns[:3], "around"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, h, waiting, window, ranked, done = None, 0, deque(), deque(), [], []

        def push(x: float) -> None:
            window.append(x)
            insort(ranked, x)
            if len(window) == 2 * h + 1:
                done.append((*waiting.popleft(), ranked[h]))
                del ranked[bisect_left(ranked, window.popleft())]

        def end() -> None:
            last = waiting[-1][2] if waiting else None
            while waiting:
                push(last)

        def batch_of(like: pa.RecordBatch) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [like.schema.field(i).type for i in range(3)] + [pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        batch = None
        for batch in batches:
            for r, at, x, half_ in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if r != rec or h != half_:
                    end()
                    rec, h = r, half_
                    window.clear(), ranked.clear()
                    for _ in range(h):
                        window.append(x), ranked.append(x)
                waiting.append((r, at, x))
                push(x)
            if done:
                yield batch_of(batch)
                done.clear()
        end()
        if done:
            yield batch_of(batch)

    return wide.repartition("rec_id").sortWithinPartitions("rec_id", order).mapInArrow(run, out)


def loud_moments(series: DataFrame, limit: int = 12, least: int = 60, half: int = 150, spread: float = 6.0, local: float = 7.0, typical: float = 3.5, join: int = 3, apart: float = 20.0) -> DataFrame:
    """(rec_id, at, end, lift): stretches much louder than ordinary talk and their surroundings, in series (rec_id, sec, db).

    Every second knows the last loud one before it, so a stretch is a run of rows: no join of stretches with the series.
    """
    facts = quantiles(series, ["rec_id"], "db", {"typical": 0.85, "quiet": 0.15})
    facts = facts.where((F.col("n") >= least) & (F.col("typical") - F.col("quiet") >= spread)).select("rec_id", "typical", F.least(F.lit(half), F.floor(F.col("n") / 2)).alias("half"))
    around = rolling_median(series.select("rec_id", "sec", "db").join(facts.select("rec_id", "half"), "rec_id"), "half")
    w = Window.partitionBy("rec_id").orderBy("sec")
    x = around.join(facts, "rec_id").withColumn("_hit", F.when(F.col("db") >= F.greatest(F.col("around") + local, F.col("typical") + typical), F.col("sec")))
    x = x.withColumn("_was", F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.coalesce((F.col("_hit").isNotNull() & F.coalesce(F.col("_hit") - F.col("_was") > join, F.lit(True))).cast("int"), F.lit(0))
    x = x.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_run > 0")
    x = x.withColumn("_last", F.max("_hit").over(Window.partitionBy("rec_id", "_run"))).where(F.col("sec") <= F.col("_last"))
    lifted = x.groupBy("rec_id", "_run").agg(F.min("sec").alias("first"), F.max("sec").alias("last"), (F.max("db") - F.first("typical")).alias("lift")).drop("_run")
    size = F.col("last") - F.col("first") + 1
    scored = lifted.where((size >= 2) | (F.col("lift") >= 8)).withColumn("score", F.col("lift") + F.least(F.lit(6), size))
    kept = greedy_spaced(scored, apart, limit)
    return kept.select("rec_id", F.col("first").cast("double").alias("at"), (F.col("last") + 1).cast("double").alias("end"), rounded("lift", 1).alias("lift"))


def chunk_edges(series: DataFrame, chunk: int = 900, tail: int = 20, durations: DataFrame | None = None) -> DataFrame:
    """(rec_id, chunk, start, end): stretches of about ``chunk`` seconds of a series (rec_id, sec, db), each ended in the middle
    of the quietest of its last ``tail`` seconds; the last takes what is left, to the end that durations (rec_id, duration) tell,
    or else of the series' whole seconds.  A fold over the seconds of one recording.
    """
    per = series.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sec", "db"))), lambda x: x["db"]).alias("v"))
    per = per.withColumn("n", F.size("v").cast("double")) if durations is None else per.join(durations.select("rec_id", F.col("duration").cast("double").alias("n")), "rec_id")

    def step(edges: Column, _: Column) -> Column:
        at = F.element_at(edges, -1)
        edge = F.floor(at + chunk).cast("int")
        low = F.greatest(edge - tail, F.lit(0))
        near = F.slice("v", low + 1, F.greatest(edge - low, F.lit(1)))
        quiet = low + F.array_position(near, F.array_min(near)) - 1
        return F.when(at >= F.col("n"), edges).when(at + chunk >= F.col("n"), F.concat(edges, F.array(F.col("n")))).otherwise(F.concat(edges, F.array(quiet + 0.5)))

    steps = F.sequence(F.lit(0), F.ceil(F.col("n") / (chunk - tail)).cast("int"))
    edged = per.select("rec_id", F.aggregate(steps, F.array(F.lit(0.0)), step).alias("e"))
    spans = F.transform(F.slice("e", F.lit(1), F.size("e") - 1), lambda x, i: F.struct(x.alias("start"), F.get(F.col("e"), i + 1).alias("end")))
    return edged.select("rec_id", F.posexplode(spans).alias("chunk", "s")).select("rec_id", "chunk", "s.start", "s.end")


def scene_cuts(scores: DataFrame, floor: float = 0.06, outright: float = 0.30, times: float = 5.0, plus: float = 0.03) -> DataFrame:
    """(rec_id, frame, score) of one-frame spikes: none of three neighbours each side is higher, and it is large or towers over the median of fifteen."""
    w = Window.partitionBy("rec_id").orderBy("frame")
    near = F.greatest(F.max("score").over(w.rowsBetween(-3, -1)), F.max("score").over(w.rowsBetween(1, 3)))
    around = F.array_sort(F.concat(F.collect_list("score").over(w.rowsBetween(-15, -1)), F.collect_list("score").over(w.rowsBetween(1, 15))))
    n = F.size("_around")
    at = lambda i: F.get("_around", i.cast("int"))
    middle = F.when(n == 0, 0.0).otherwise((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)
    found = scores.withColumn("_near", near).withColumn("_around", around).withColumn("_base", middle)
    return found.where((F.col("score") >= floor) & ~F.coalesce(F.col("score") < F.col("_near"), F.lit(False)) & ((F.col("score") >= outright) | (F.col("score") >= times * F.col("_base") + plus))).select("rec_id", "frame", "score")


def steady_gain(clips: DataFrame, target: float = -14.0) -> DataFrame:
    """clips (lufs, ...) with gain: the decibels to the target, 20 at most either way; 0 where the measure is of no use."""
    ok = (F.col("lufs") > -70) & (F.col("lufs") < 0)
    return clips.withColumn("gain", F.when(ok, F.greatest(F.lit(-20.0), F.least(F.lit(20.0), target - F.col("lufs")))).otherwise(0.0))
