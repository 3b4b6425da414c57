"""Joins and folds over timed rows of recordings.

Every operator takes and returns DataFrames keyed by ``rec_id``; order is a column.  Range joins come with an equality on
``rec_id`` and on a time bucket; moments meet what began before them in one union and one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Results depend on these lengths (seconds of quiet kept before and after a clip's words).
LEAD_IN, TAIL = 0.10, 0.30


def buckets(start: Column, end: Column, width: float) -> Column:
    """The time buckets that [start, end] touches."""
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(a: DataFrame, b: DataFrame, width: float, a_start: str, a_end: str, b_start: str, b_end: str, strict: bool = False) -> DataFrame:
    """Rows of a and b of one rec_id whose intervals meet (strict: share more than a point).

    Both sides are dealt into time buckets; a pair counts in the bucket where the later of the two begins, so it comes once.
    """
    x = a.withColumn("_bucket", F.explode(buckets(F.col(a_start), F.col(a_end), width)))
    y = b.withColumn("_bucket", F.explode(buckets(F.col(b_start), F.col(b_end), width)))
    later = F.floor(F.greatest(F.col(a_start), F.col(b_start)) / width)
    meets = (F.col(a_start) < F.col(b_end)) & (F.col(b_start) < F.col(a_end)) if strict else (F.col(a_start) <= F.col(b_end)) & (F.col(b_start) <= F.col(a_end))
    return x.join(y, ["rec_id", "_bucket"]).where(meets & (later == F.col("_bucket"))).drop("_bucket")


def last_word_before(words: DataFrame, pauses: DataFrame, slack: float = 0.1) -> DataFrame:
    """(rec_id, word_idx, length): the longest pause after each word.

    A pause follows the last word that starts before the pause does, ``slack`` later; pauses before the first or after
    the last word are dropped.  One union and one window: no range join.
    """
    last = words.groupBy("rec_id").agg(F.max("word_idx").alias("last_idx"))
    w = words.select("rec_id", F.col("start").alias("t"), F.lit(1).alias("tag"), "word_idx", F.lit(None).cast("double").alias("length"))
    p = pauses.select("rec_id", (F.col("start") + slack).alias("t"), F.lit(0).alias("tag"), F.lit(None).cast("int").alias("word_idx"), (F.col("end") - F.col("start")).alias("length"))
    over = Window.partitionBy("rec_id").orderBy("t", "tag").rowsBetween(Window.unboundedPreceding, 0)
    found = w.unionByName(p).withColumn("idx", F.last("word_idx", ignorenulls=True).over(over)).where("tag = 0 and idx is not null")
    return found.join(last, "rec_id").where("idx < last_idx").groupBy("rec_id", F.col("idx").alias("word_idx")).agg(F.max("length").alias("length"))


def nearest_line(lines: DataFrame, points: DataFrame, reach: float = 45.0) -> DataFrame:
    """(rec_id, idx, views): views of the points nearest to each line, at most ``reach`` away; ties go to the first line."""
    x = points.withColumn("_bucket", F.explode(buckets(F.col("at") - reach, F.col("at") + reach, 2 * reach))).withColumn("_id", F.struct("rec_id", "at", "point_id"))
    y = lines.withColumn("_bucket", F.explode(buckets(F.col("start"), F.col("end"), 2 * reach)))
    far = F.when(F.col("at").between(F.col("start"), F.col("end")), 0.0).otherwise(F.least(F.abs(F.col("start") - F.col("at")), F.abs(F.col("end") - F.col("at"))))
    near = x.join(y, ["rec_id", "_bucket"]).withColumn("far", far).where(F.col("far") <= reach)
    best = near.groupBy("_id").agg(F.min(F.struct("far", "idx", "rec_id", "views")).alias("m"))
    return best.groupBy("m.rec_id", "m.idx").agg(F.sum("m.views").alias("views"))


def on_at(times: DataFrame, shows: DataFrame) -> DataFrame:
    """times (rec_id, t, ...) with ``on``: the name of the last of shows (rec_id, at, name) that began by then, null before the first.

    Of shows that begin at once the last by name counts.  One union and one window: no pairs, and no recording's shows in one row.
    """
    s = shows.select("rec_id", F.col("at").cast("double").alias("_at"), F.lit(0).alias("_tag"), F.col("name").alias("_name"))
    x = times.select("*", F.col("t").cast("double").alias("_at"), F.lit(1).alias("_tag")).unionByName(s, allowMissingColumns=True)
    upto = Window.partitionBy("rec_id").orderBy("_at", "_tag", "_name").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("on", F.last("_name", ignorenulls=True).over(upto)).where("_tag = 1").select(*times.columns, "on")


def stretch_parts(windows: DataFrame, runs: DataFrame, least: float = 12.0, slack: float = 1.0) -> DataFrame:
    """(rec_id, idx, run, file, offset, origin, length, why): what is looked at closely of windows (rec_id, idx, start, end, why).

    runs (rec_id, run, seq, start, end, length) are the pieces of uninterrupted stretches; the pieces that a window, ``slack``
    wider on both sides, touches in one run are one file, as long as its length column tells (null: as the pieces together).
    A file, or what a window keeps of it, that is shorter than ``least`` seconds goes.  idx counts what is left in the order of windows
    and runs; offset is the place in the file, origin the place in the recording.
    """
    spans = windows.select("rec_id", F.col("idx").alias("window"), F.col("start").alias("a"), F.col("end").alias("b"), "why")
    wide = spans.withColumn("wa", F.col("a") - slack).withColumn("wb", F.col("b") + slack)
    met = overlap_join(wide, runs.select("rec_id", "run", "seq", F.col("start").alias("p_start"), F.col("end").alias("p_end")), 60.0, "wa", "wb", "p_start", "p_end", strict=True)
    files = met.groupBy("rec_id", "window", "run", "a", "b", "why").agg(F.min("p_start").alias("begin"), F.max_by("p_end", "seq").alias("stop"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    lengths = runs.where("length is not null").select("rec_id", "run", F.col("seq").alias("first"), "length")
    files = files.where(F.col("stop") - F.col("begin") >= least).join(lengths, ["rec_id", "run", "first"], "left")
    whole = F.coalesce("length", F.col("stop") - F.col("begin"))
    kept = files.withColumn("origin", F.greatest("a", "begin")).withColumn("_b", F.least(F.col("b"), F.col("begin") + whole)).where(F.col("_b") - F.col("origin") >= least)
    order = F.row_number().over(Window.partitionBy("rec_id").orderBy("window", "run")) - 1
    file = F.format_string("%02d", F.row_number().over(Window.partitionBy("rec_id").orderBy("window", "run")))
    return kept.select("rec_id", order.alias("idx"), "run", file.alias("file"), (F.col("origin") - F.col("begin")).alias("offset"), "origin", (F.col("_b") - F.col("origin")).alias("length"), "why")


def laid_parts(stretches: DataFrame, rate: int = 16000, gap: float = 1.0) -> DataFrame:
    """(rec_id, idx, start, end, origin, file, offset, why): the parts of a transcript, stretches end to end on the working clock."""
    plan = stitch_plan(stretches, rate, gap).select("rec_id", "idx", "start", "end")
    return stretches.join(plan, ["rec_id", "idx"]).select("rec_id", "idx", "start", "end", "origin", "file", "offset", "why")


def loud_lines(lines: DataFrame, loud: DataFrame, slack: float = 1.0) -> DataFrame:
    """Lines that a loud moment touches, ``slack`` seconds around it."""
    wide = loud.select("rec_id", (F.col("at") - slack).alias("l_start"), (F.col("end") + slack).alias("l_end"))
    return overlap_join(lines, wide, 60.0, "start", "end", "l_start", "l_end").select(lines.columns).distinct()


def part_at(times: DataFrame, parts: DataFrame) -> DataFrame:
    """times with part_idx and origin_time: the part a moment falls in, or else the nearest by its edges (then the first).

    Recordings have a handful of parts, which travel as one array; rows of times stay as they are, equal ones too.  Without
    parts part_idx is null and origin_time is t.
    """
    p = parts.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("idx", "start", "end", "origin"))).alias("_parts"))
    t = F.col("t")

    def key(x: Column) -> Column:
        outside = ~((x["start"] <= t) & (t < x["end"]))
        far = F.when(outside, F.least(F.abs(x["start"] - t), F.abs(x["end"] - t))).otherwise(0.0)
        return F.struct(outside.alias("out"), far.alias("far"), x["idx"].alias("part_idx"), (x["origin"] + (t - x["start"])).alias("origin_time"))

    found = times.join(p, "rec_id", "left").withColumn("_m", F.array_min(F.transform("_parts", key)))
    return found.select(*times.columns, F.col("_m.part_idx").alias("part_idx"), F.coalesce("_m.origin_time", t).alias("origin_time"))


def part_breaks(words: DataFrame, parts: DataFrame) -> DataFrame:
    """words with part_idx and part_end: whether the next word belongs to another part."""
    owned = part_at(words.withColumn("t", F.col("start")), parts).drop("t", "origin_time")
    following = F.lead("part_idx").over(Window.partitionBy("rec_id").orderBy("word_idx"))
    return owned.withColumn("part_end", F.coalesce(following != F.col("part_idx"), F.lit(False)))


def words_inside(words: DataFrame, parts: DataFrame, slack: float = 0.05) -> DataFrame:
    """The words that lie whole in a part, both on the working clock; an end may be ``slack`` late."""
    p = parts.select("rec_id", F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.explode(buckets(F.col("start"), F.col("end"), 60.0)).alias("_bucket"))
    w = words.withColumn("_bucket", F.floor(F.col("start") / 60.0)).alias("w")
    inside = (F.col("w.start") >= F.col("p_start")) & (F.col("w.end") <= F.col("p_end") + slack)
    return w.join(p.alias("p"), (F.col("w.rec_id") == F.col("p.rec_id")) & (F.col("w._bucket") == F.col("p._bucket")) & inside, "left_semi").drop("_bucket")


def words_in_parts(words: DataFrame, parts: DataFrame, slack: float = 0.05) -> DataFrame:
    """(rec_id, part_idx, word_idx, text, start, end): words inside each part, on the working clock; a word may lie in several."""
    last = F.col("origin") + (F.col("end") - F.col("start"))
    p = parts.select("rec_id", F.col("idx").alias("part_idx"), "origin", F.col("start").alias("p_start"), (F.col("end") - F.col("start")).alias("length"), F.explode(buckets(F.col("origin"), last, 60.0)).alias("_bucket"))
    inside = (F.col("start") >= F.col("origin")) & (F.col("end") <= F.col("origin") + F.col("length") + slack)
    moved = lambda c: (F.col("p_start") + (F.col(c) - F.col("origin"))).alias(c)
    found = words.withColumn("_bucket", F.floor(F.col("start") / 60.0)).join(p, ["rec_id", "_bucket"]).where(inside)
    return found.select("rec_id", "part_idx", "word_idx", "text", moved("start"), moved("end"))


def lay_end_to_end(windows: DataFrame, gap: float = 1.0) -> DataFrame:
    """Windows with their place on the working clock: one after another, ``gap`` seconds apart."""
    before = Window.partitionBy("rec_id").orderBy("start", "idx").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("end") - F.col("start") + gap).over(before), F.lit(0.0))
    return windows.withColumn("work_start", at).withColumn("work_end", at + (F.col("end") - F.col("start")))


def islands(rows: DataFrame, flag: Column, order: str = "idx", by: str = "rec_id") -> DataFrame:
    """(rec_id, first, last) of runs of neighbouring rows with the flag; ``order`` counts rows without holes."""
    w = Window.partitionBy(by).orderBy(order)
    on = rows.where(flag).withColumn("_run", F.col(order) - F.row_number().over(w))
    return on.groupBy(by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last")).drop("_run")


def merge_gaps(rows: DataFrame, gap: Column | float, at: str = "t", by: str = "rec_id") -> DataFrame:
    """(rec_id, first, last, n) of rows that follow each other at most ``gap`` apart."""
    w = Window.partitionBy(by).orderBy(at)
    begins = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    numbered = rows.withColumn("_begin", begins).withColumn("_run", F.sum("_begin").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_run")


def removed_middles(clips: DataFrame, silences: DataFrame, words: DataFrame, max_pause: float = 0.6, after: float = 0.18, before: float = 0.12) -> DataFrame:
    """(rec_id, clip, cut_start, cut_end): the middles of long pauses inside clips that hold no whole word."""
    s = silences.select("rec_id", F.col("start").alias("a"), F.col("end").alias("b")).where(F.col("b") - F.col("a") > max_pause)
    c = clips.select("rec_id", "clip", "start", "end", F.explode(buckets(F.col("start"), F.col("end"), 60.0)).alias("_bucket"))
    cuts = s.withColumn("_bucket", F.floor(F.col("a") / 60.0)).join(c, ["rec_id", "_bucket"]).where("a > start and b < end").drop("_bucket")
    cuts = cuts.withColumn("cut_start", F.col("a") + after).withColumn("cut_end", F.col("b") - before).where("cut_end - cut_start >= 0.15")
    w = words.select("rec_id", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    x = cuts.withColumn("_bucket", F.explode(buckets(F.col("cut_start"), F.col("cut_end"), 10.0)))
    y = w.withColumn("_bucket", F.floor(F.col("w_start") / 10.0))
    held = x.alias("x").join(y.alias("y"), (F.col("x.rec_id") == F.col("y.rec_id")) & (F.col("x._bucket") == F.col("y._bucket")) & (F.col("cut_start") <= F.col("w_start")) & (F.col("w_end") <= F.col("cut_end")) & (F.col("w_end") > F.col("x.start")) & (F.col("w_start") < F.col("x.end")), "left_semi")
    return cuts.join(held.select("rec_id", "clip", "cut_start").distinct(), ["rec_id", "clip", "cut_start"], "left_anti").select("rec_id", "clip", "cut_start", "cut_end")


def kept_pieces(clips: DataFrame, cuts: DataFrame) -> DataFrame:
    """(rec_id, clip, piece, start, end, clip_start): what is left of clips, with each piece's place on the clip's clock."""
    edges = clips.select("rec_id", "clip", F.col("start").alias("at"), F.lit(None).cast("double").alias("stop")).unionByName(cuts.select("rec_id", "clip", F.col("cut_end").alias("at"), F.col("cut_start").alias("stop")))
    w = Window.partitionBy("rec_id", "clip").orderBy("at")
    ends = clips.select("rec_id", "clip", F.col("end").alias("clip_end"))
    p = edges.join(ends, ["rec_id", "clip"]).withColumn("piece", F.row_number().over(w) - 1).withColumn("end", F.coalesce(F.lead("stop").over(w), F.col("clip_end")))
    p = p.select("rec_id", "clip", "piece", F.col("at").alias("start"), "end")
    before = Window.partitionBy("rec_id", "clip").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("clip_start", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0.0)))


def retime(times: DataFrame, pieces: DataFrame) -> DataFrame:
    """times (rec_id, clip, t, ...) with clip_t: the moment on the clip's clock; moments that were cut go to the join.

    Each moment meets the last piece that began before it: one union and one window.  Equal rows stay separate.
    """
    p = pieces.select("rec_id", "clip", F.col("start").alias("_at"), F.lit(0).alias("_tag"), F.struct("start", "end", "clip_start").alias("_p"))
    x = times.select("*", F.col("t").alias("_at"), F.lit(1).alias("_tag")).unionByName(p, allowMissingColumns=True)
    upto = Window.partitionBy("rec_id", "clip").orderBy("_at", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    met = x.withColumn("_p", F.last("_p", ignorenulls=True).over(upto)).where("_tag = 1")
    at = F.col("_p.clip_start") + F.least(F.col("t"), F.col("_p.end")) - F.col("_p.start")
    return met.select(*times.columns, F.coalesce(at, F.lit(0.0)).alias("clip_t"))


def snapped(clips: DataFrame, words: DataFrame, silences: DataFrame, durations: DataFrame) -> DataFrame:
    """clips (rec_id, clip, first, last) with start and end that clip no speech and keep no dead air.

    A pause that ends about where the first word begins marks the start, one that begins during the last word the end;
    without them, a part of the gap to the neighbouring word is kept.  An edge that would lie inside a pause moves to its
    end (start) or beginning (end).  Only the pauses around the two edges meet a clip, in a fold in their order.
    """
    w = Window.partitionBy("rec_id").orderBy("word_idx")
    x = words.select("rec_id", "word_idx", "start", "end", F.lag("end").over(w).alias("_before"), F.lead("start").over(w).alias("_next"))
    head = x.select("rec_id", F.col("word_idx").alias("first"), F.col("start").alias("h_start"), F.col("end").alias("h_end"), F.coalesce("_before", F.lit(0.0)).alias("before"))
    tail = x.select("rec_id", F.col("word_idx").alias("last"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), "_next")
    c = clips.join(head, ["rec_id", "first"]).join(tail, ["rec_id", "last"]).join(durations.select("rec_id", F.col("duration").alias("whole")), "rec_id")
    c = c.withColumn("following", F.coalesce("_next", "whole"))
    around = F.array(F.struct((F.col("h_start") - 0.6).alias("a"), (F.col("h_start") + 0.3).alias("b")), F.struct((F.col("t_start") - 0.4).alias("a"), (F.col("t_end") + 0.8).alias("b")))
    edges = c.select("rec_id", "clip", F.explode(around).alias("e")).select("rec_id", "clip", F.col("e.a").alias("e_start"), F.col("e.b").alias("e_end"))
    s = silences.select("rec_id", F.col("start").alias("a"), F.col("end").alias("b"))
    near = overlap_join(edges, s, 10.0, "e_start", "e_end", "a", "b").groupBy("rec_id", "clip").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("_s"))
    c = c.join(near, ["rec_id", "clip"], "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<a:double,b:double>>")))
    h, t, over = F.col("h_start"), F.col("t_start"), F.col("following")
    onset = F.array_min(F.transform(F.filter("_s", lambda p: (p["b"] >= h - 0.45) & (p["b"] <= h + 0.20)), lambda p: F.struct(F.abs(p["b"] - h).alias("far"), p["a"].alias("a"), p["b"].alias("b"))))
    offset = F.try_element_at(F.filter("_s", lambda p: (p["a"] >= t + 0.05) & (p["a"] <= F.col("t_end") + 0.45) & (p["a"] <= over + 0.2)), F.lit(1))
    c = c.withColumn("_on", onset).withColumn("_off", offset)
    start = F.when(F.col("_on").isNotNull(), F.greatest(F.col("_on.a") + 0.02, F.col("_on.b") - LEAD_IN)).otherwise(h - F.least(F.lit(LEAD_IN), F.greatest(h - F.col("before"), F.lit(0.0)) / 2))
    end = F.when(F.col("_off").isNotNull(), F.least(F.col("_off.a") + TAIL, F.col("_off.b") - 0.02)).otherwise(F.col("t_end") + F.least(F.lit(0.15), F.greatest(over - F.col("t_end"), F.lit(0.0)) / 2))
    start = F.aggregate("_s", start, lambda at, p: F.when((p["a"] <= at + 0.05) & (at + LEAD_IN + 0.05 < p["b"]) & (p["b"] < t), p["b"] - LEAD_IN).otherwise(at))
    end = F.aggregate("_s", end, lambda at, p: F.when((F.col("h_end") < p["a"]) & (p["a"] < at - TAIL - 0.05) & (p["b"] >= at - 0.05), p["a"] + TAIL).otherwise(at))
    c = c.withColumn("start", F.greatest(F.lit(0.0), start)).withColumn("_end", end)
    end = F.when(F.col("whole") != 0, F.least("whole", "_end")).otherwise(F.col("_end"))
    return c.select(*clips.columns, "start", F.greatest(end, F.col("start") + 0.5).alias("end"))


def samples_in_shots(samples: DataFrame, shots: DataFrame) -> DataFrame:
    """samples (rec_id, t, ...) with the shot (shot, t0, t1) that they fall in: t0 <= t < t1."""
    s = shots.select("rec_id", "shot", F.col("start").alias("t0"), F.col("end").alias("t1"), F.explode(buckets(F.col("start"), F.col("end"), 30.0)).alias("_bucket"))
    return samples.withColumn("_bucket", F.floor(F.col("t") / 30.0)).join(s, ["rec_id", "_bucket"]).where("t0 <= t and t < t1").drop("_bucket")


def kept_frames(pieces: DataFrame, fps: int = 30, least: int = 2) -> DataFrame:
    """(rec_id, clip, piece, first, last) in whole frames from the clip's start; pieces shorter than ``least`` frames go."""
    w = Window.partitionBy("rec_id", "clip")
    begin = F.min("start").over(w)
    frame = lambda c: F.bround((F.col(c) - F.col("_begin")) * fps, 0).cast("long")
    x = pieces.withColumn("_begin", begin)
    return x.select("rec_id", "clip", "piece", frame("start").alias("first"), frame("end").alias("last")).where(F.col("last") - F.col("first") >= least)


def stitch_plan(items: DataFrame, rate: int = 16000, gap: float = 1.0) -> DataFrame:
    """(rec_id, idx, src_frame, dst_frame, n, start, end): where the sound of each item (rec_id, idx, offset, length) goes when
    they are laid end to end, ``gap`` seconds apart, in samples and on the working clock.  Running sums of whole samples.
    """
    n = F.bround(F.col("length") * rate, 0).cast("long")
    before = Window.partitionBy("rec_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    x = items.withColumn("n", n).withColumn("dst_frame", F.coalesce(F.sum(F.col("n") + int(gap * rate)).over(before), F.lit(0)))
    return x.select("rec_id", "idx", F.bround(F.col("offset") * rate, 0).cast("long").alias("src_frame"), "dst_frame", "n", (F.col("dst_frame") / rate).alias("start"), ((F.col("dst_frame") + F.col("n")) / rate).alias("end"))


def sound_plan(pieces: DataFrame, limit: float, rate: int = 16000, stub: float = 5.0) -> DataFrame:
    """(list_id, run, dst_frame, n): the samples that each uninterrupted run of pieces begun before ``limit`` takes on the
    playlist's clock; runs shorter than ``stub`` seconds leave silence.
    """
    per = pieces.where(F.col("start") < limit).groupBy("list_id", "run").agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("duration")).alias("b")).where(F.col("b") - F.col("a") >= stub)
    at = lambda c: F.bround(F.col(c) * rate, 0).cast("long")
    written = F.coalesce(F.max(at("b")).over(Window.partitionBy("list_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = per.withColumn("dst_frame", F.greatest(at("a"), written))
    return x.select("list_id", "run", "dst_frame", F.greatest(at("b") - F.col("dst_frame"), F.lit(0)).alias("n"))


def cut_segments(kept: DataFrame, segments: DataFrame, fps: int = 30) -> DataFrame:
    """(rec_id, clip, first, last, kind, framing): the frames of each layout inside the kept ranges of a clip.

    kept is (rec_id, clip, first, last) in frames, segments (rec_id, clip, start, end, kind, framing) in seconds; neither overlaps
    itself within a clip.  Neighbours of one kind and one framing are joined.  The first and last piece of each kept range are
    stretched to its edges; a range in which no piece begins is one ``fit`` without framing.  A sweep over the points where
    something begins or ends: one union, grouped by point, and running values in its order.
    """
    by = ["rec_id", "clip"]
    frame = lambda c: F.bround(F.col(c) * fps, 0).cast("long")
    s = segments.select(*by, frame("start").alias("sa"), frame("end").alias("sb"), "kind", "framing").where("sb > sa")
    whole = F.struct(F.col("sa"), F.col("sb"), "kind", "framing").alias("_s")
    range_ = F.struct(F.col("first").alias("fa"), F.col("last").alias("fb")).alias("_k")
    no_s, no_k = F.lit(None).cast(s.select(whole).schema["_s"].dataType).alias("_s"), F.lit(None).cast(kept.select(range_).schema["_k"].dataType).alias("_k")
    k = kept.where("last > first")
    points = (
        s.select(*by, F.col("sa").alias("at"), whole, no_k).unionByName(s.select(*by, F.col("sb").alias("at"), no_s, no_k))
        .unionByName(k.select(*by, F.col("first").alias("at"), no_s, range_)).unionByName(k.select(*by, F.col("last").alias("at"), no_s, no_k))
    )
    w = Window.partitionBy(*by).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    begins = points.groupBy(*by, "at").agg(F.max_by("_s", F.col("_s.sa")).alias("_s"), F.max("_k").alias("_k"))
    swept = begins.select(*by, "at", F.lead("at").over(w).alias("until"), F.last("_s", ignorenulls=True).over(upto).alias("_s"), F.last("_k", ignorenulls=True).over(upto).alias("_k"))
    pieces = swept.where("_k.fb > at and _s.sb > at").select(*by, "at", "until", F.col("_k.fa").alias("fa"), F.col("_k.fb").alias("fb"), F.col("_s.kind").alias("kind"), F.col("_s.framing").alias("framing"))
    same = (F.lag("until").over(w) == F.col("at")) & F.lag("kind").over(w).eqNullSafe(F.col("kind")) & F.lag("framing").over(w).eqNullSafe(F.col("framing"))
    runs = pieces.withColumn("_run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(upto)).groupBy(*by, "_run").agg(
        F.min("at").alias("a"), F.max("until").alias("b"), F.min_by(F.struct("fa", "fb", "kind", "framing"), "at").alias("_p"))
    v = Window.partitionBy(*by, "_p.fa").orderBy("a")
    first, last = F.lag("a").over(v).isNull(), F.lead("a").over(v).isNull()
    inside = runs.select(*by, F.col("_p.fa").alias("fa"), F.when(first, F.col("_p.fa")).otherwise(F.col("a")).alias("first"), F.when(last, F.col("_p.fb")).otherwise(F.col("b")).alias("last"), F.col("_p.kind").alias("kind"), F.col("_p.framing").alias("framing"))
    none = k.withColumn("fa", F.col("first")).join(inside.select(*by, "fa"), [*by, "fa"], "left_anti").select(*by, "first", "last", F.lit("fit").alias("kind"), F.lit(None).cast(s.schema["framing"].dataType).alias("framing"))
    return inside.drop("fa").unionByName(none)
