"""Playlist text to pieces, runs and quality levels.

Input is (list_id, line_no, line), one row per line; state that a reader would carry is a window function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.links import to_float, to_int
from tempora.operators.temporal import overlap_join


def attribute(line: Column, name: str) -> Column:
    """The value of NAME=value or NAME="value" in a tag line; empty if it is not there."""
    found = F.regexp_extract(line, rf'(?:^|[,:]){name}=("[^"]*"|[^,]*)', 1)
    return F.trim(found, F.lit('"'))


def resolved(base: Column, url: Column) -> Column:
    """A link relative to a folder or host."""
    host = F.regexp_extract(base, r"^(https?://[^/]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/[^/]*$", "/")
    return F.when(url.rlike(r"^https?://"), url).when(url.startswith("/"), F.concat(host, url)).otherwise(F.concat(folder, url))


def faults(lines: DataFrame, master: bool = False) -> DataFrame:
    """(list_id, fault) of playlists that cannot be used: no playlist, encrypted, in byte ranges, sound kept apart, or empty."""
    x = lines.withColumn("line", F.trim("line")).where("line <> ''")
    starts = lambda *tags: F.bool_or(F.greatest(*[F.col("line").startswith(t) for t in tags]) if len(tags) > 1 else F.col("line").startswith(tags[0]))
    method = attribute(F.col("line"), "METHOD")
    facts = x.groupBy("list_id").agg(
        F.min_by("line", "line_no").alias("head"), starts("#EXTINF").alias("timed"), starts("#EXT-X-STREAM-INF:").alias("levels"), F.bool_or(~F.col("line").startswith("#")).alias("links"),
        F.bool_or(F.col("line").startswith("#EXT-X-KEY:") & ~method.isin("", "NONE")).alias("locked"), starts("#EXT-X-BYTERANGE").alias("ranges"), F.bool_or(F.col("line").startswith("#EXT-X-MEDIA:") & (attribute(F.col("line"), "URI") != "")).alias("apart"),
    )
    fault = F.when(~F.col("head").startswith("#EXTM3U"), "no playlist")
    if master:
        fault = fault.when(F.col("timed"), F.lit(None)).when(F.col("apart"), "sound apart").when(~(F.col("levels") & F.col("links")), "empty")
    else:
        fault = fault.when(F.col("locked"), "encrypted").when(F.col("ranges"), "byte ranges").when(~(F.col("timed") & F.col("links")), "empty")
    return facts.select("list_id", fault.alias("fault")).where("fault is not null")


def media_pieces(lines: DataFrame) -> DataFrame:
    """(list_id, seq, url, start, duration, run, init) of media playlists (list_id, line_no, line, base)."""
    w = Window.partitionBy("list_id").orderBy("line_no")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("line", F.trim("line")).where("line <> ''")
    timed = F.when(F.col("line").startswith("#EXTINF:"), to_float(F.regexp_extract("line", r"^#EXTINF:([^,]*)", 1)))
    uri = ~F.col("line").startswith("#")
    x = x.withColumn("_t", timed).withColumn("_uri", uri)
    # a link counts if a length came since the last link
    x = x.withColumn("_links", F.coalesce(F.sum(F.col("_uri").cast("int")).over(before), F.lit(0)))
    since = Window.partitionBy("list_id", "_links").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_len", F.last("_t", ignorenulls=True).over(since)).withColumn("_piece", F.col("_uri") & F.col("_len").isNotNull())
    x = x.withColumn("_had", F.coalesce(F.sum(F.col("_piece").cast("int")).over(before), F.lit(0)))
    broken = F.col("line").startswith("#EXT-X-DISCONTINUITY") & ~F.col("line").startswith("#EXT-X-DISCONTINUITY-SEQUENCE") & (F.col("_had") > 0)
    x = x.withColumn("_break", broken.cast("int"))
    init = F.when(F.col("line").startswith("#EXT-X-MAP:"), resolved(F.col("base"), attribute(F.col("line"), "URI")))
    x = x.withColumn("_init", init).withColumn("_was", F.coalesce(F.last("_init", ignorenulls=True).over(before), F.lit("")))
    # a new header begins a run unless a break (or another header) already did since the last piece
    in_gap = Window.partitionBy("list_id", "_had").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    changed = F.col("_init").isNotNull() & (F.col("_init") != F.col("_was")) & (F.col("_had") > 0)
    x = x.withColumn("_changed", changed.cast("int"))
    earlier = F.coalesce(F.max(F.greatest("_break", "_changed")).over(in_gap), F.lit(0))
    x = x.withColumn("_new", F.col("_break") + F.when((F.col("_changed") == 1) & (earlier == 0), 1).otherwise(0))
    x = x.withColumn("run", F.sum("_new").over(upto)).withColumn("init", F.coalesce(F.last("_init", ignorenulls=True).over(upto), F.lit("")))
    p = x.where("_piece")
    clock = F.coalesce(F.sum("_len").over(before), F.lit(0.0))
    return p.select("list_id", (F.row_number().over(w) - 1).alias("seq"), resolved(F.col("base"), F.col("line")).alias("url"), clock.alias("start"), F.col("_len").alias("duration"), F.col("run").cast("int").alias("run"), "init")


def runs(pieces: DataFrame) -> DataFrame:
    """(list_id, run, start, end) of each uninterrupted stretch."""
    return pieces.groupBy("list_id", "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("duration")).alias("end"))


def between(pieces: DataFrame, spans: DataFrame) -> DataFrame:
    """(list_id, span_id, run, urls): the pieces that each span (list_id, span_id, a, b) touches, by run, in order."""
    p = pieces.select(F.col("list_id").alias("rec_id"), "run", "seq", "url", "start", (F.col("start") + F.col("duration")).alias("stop"))
    inside = overlap_join(p, spans.select(F.col("list_id").alias("rec_id"), "span_id", "a", "b"), 60.0, "start", "stop", "a", "b", strict=True).withColumnRenamed("rec_id", "list_id")
    return inside.groupBy("list_id", "span_id", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "url"))), lambda x: x["url"]).alias("urls"))


def master_levels(lines: DataFrame) -> DataFrame:
    """(list_id, level, url, name, bandwidth, width, height, fps, codecs) of master playlists (list_id, line_no, line, base); a media playlist is one level."""
    w = Window.partitionBy("list_id").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("line", F.trim("line")).where("line <> ''")
    info = F.when(F.col("line").startswith("#EXT-X-STREAM-INF:"), F.col("line"))
    x = x.withColumn("_info", info).withColumn("_uri", (~F.col("line").startswith("#")).cast("int"))
    x = x.withColumn("_links", F.coalesce(F.sum("_uri").over(before), F.lit(0)))
    since = Window.partitionBy("list_id", "_links").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    levels = x.withColumn("_p", F.last("_info", ignorenulls=True).over(since)).where("_uri = 1 and _p is not null")
    names = x.where(F.col("line").startswith("#EXT-X-MEDIA:")).groupBy("list_id", attribute(F.col("line"), "GROUP-ID").alias("grp")).agg(F.max_by(attribute(F.col("line"), "NAME"), "line_no").alias("named"))
    size = F.lower(attribute(F.col("_p"), "RESOLUTION"))
    levels = levels.withColumn("grp", attribute(F.col("_p"), "VIDEO")).join(names, ["list_id", "grp"], "left")
    plain = x.where(F.col("line").startswith("#EXTINF")).groupBy("list_id").agg(F.first("base").alias("base"))
    none, zero = F.lit(""), F.lit(0).cast("long")
    single = plain.select("list_id", F.lit(0).alias("level"), F.col("base").alias("url"), F.lit("only").alias("name"), zero.alias("bandwidth"), zero.alias("width"), zero.alias("height"), F.lit(0.0).alias("fps"), none.alias("codecs"))
    return single.unionByName(levels.join(plain.select("list_id"), "list_id", "left_anti").select(
        "list_id", (F.row_number().over(w) - 1).alias("level"), resolved(F.col("base"), F.col("line")).alias("url"), F.coalesce(F.nullif(F.col("named"), F.lit("")), "grp").alias("name"), to_int(attribute(F.col("_p"), "BANDWIDTH")).alias("bandwidth"),
        to_int(F.substring_index(size, "x", 1)).alias("width"), to_int(F.when(size.contains("x"), F.substring_index(size, "x", -1)).otherwise("")).alias("height"), to_float(attribute(F.col("_p"), "FRAME-RATE")).alias("fps"), attribute(F.col("_p"), "CODECS").alias("codecs"),
    ))


def video_codec(codecs: Column) -> Column:
    low = F.lower(codecs)
    return F.when(low.rlike("avc1|avc3"), "h264").when(low.rlike("hvc1|hev1"), "hevc").when(low.contains("av01"), "av1").otherwise("")


def sound_only(codecs: Column, name: Column, height: Column) -> Column:
    """By the codecs, or without them by a name that says so and no height."""
    told = F.coalesce(codecs, F.lit("")) != ""
    return F.when(told, (video_codec(codecs) == "") & F.lower(codecs).contains("mp4a")).otherwise((F.coalesce(height, F.lit(0)) == 0) & F.lower(F.coalesce(name, F.lit(""))).contains("audio"))


def chosen_levels(levels: DataFrame, most: int = 1080) -> DataFrame:
    """(list_id, scan, best): the cheapest level that carries the sound, and the sharpest picture up to ``most`` lines, h264 first."""
    v = levels.withColumn("audio", sound_only(F.col("codecs"), F.col("name"), F.col("height"))).withColumn("codec", video_codec(F.col("codecs")))
    rate, lines = F.nullif(F.col("bandwidth"), F.lit(0)), F.nullif(F.col("height"), F.lit(0))
    cheap = F.min_by("level", F.when(F.col("audio"), F.struct(F.lit(0).alias("a"), F.coalesce("bandwidth", F.lit(0)).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), "level")).otherwise(F.struct(F.lit(1).alias("a"), F.coalesce(rate, F.lit(10**12)).cast("long").alias("b"), F.coalesce(lines, F.lit(10**6)).cast("long").alias("c"), "level")))
    tall = F.coalesce(lines, F.lit(most))
    rank = F.when(F.col("codec") == "h264", 0).when(F.col("codec") == "", 1).when(F.col("codec") == "hevc", 2).otherwise(3)
    over = (tall > most).cast("int")
    # if all are too tall, the lowest is taken whatever its codec
    key = F.struct(over.alias("o"), F.when(tall > most, F.coalesce(lines, F.lit(10**6))).otherwise(-tall).alias("h"), F.when(tall > most, 0).otherwise(rank).alias("r"), F.when(tall > most, 0).otherwise(-F.col("bandwidth")).alias("b"), "level")
    best = v.where(~F.col("audio")).groupBy("list_id").agg(F.min_by("level", key).alias("best"))
    return v.groupBy("list_id").agg(cheap.alias("scan")).join(best, "list_id", "left")
