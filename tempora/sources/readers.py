"""Readers of transcripts, sound, feeds and model replies."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "version int, language string, duration double, model string, pauses map<string,double>, parts array<struct<index:int,start:double,end:double,origin:double,file:string,offset:double,why:string>>, words array<array<string>>"


# Containers that can be cut at any moment.
INDEXED = ["mp4", "mov", "matroska", "webm", "wav", "flac", "ogg"]

FILES = {
    "scan": "meta struct<title:string,duration:double>, lines array<array<string>>, loud array<struct<at:double,end:double,lift:double>>, hints array<struct<at:double,views:bigint,title:string>>",
    "windows": "picker string, model string, note string, windows array<struct<start:double,end:double,why:string,score:double>>",
    "picks": "picker string, model string, note string, clips array<struct<rank:int,first:int,last:int,title:string,caption:string,hashtags:array<string>,why:string,score:double,first_word:int,last_word:int,start:double,end:double>>",
}


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(rec_id, language, duration, model, pauses, parts, words) of transcript files; missing fields get defaults."""
    # as whole texts: the JSON source goes back to the file for each number that is read as text
    text = spark.read.text(path, wholetext=True).where(F.trim("value", F.lit(" \t\r\n")) != "").select(F.col("_metadata.file_name").alias("rec_id"), F.from_json("value", TRANSCRIPT).alias("t"))
    raw = text.select("rec_id", "t.*")
    return raw.select("rec_id", F.coalesce("language", F.lit("en")).alias("language"), F.coalesce("duration", F.lit(0.0)).alias("duration"), F.coalesce("model", F.lit("")).alias("model"), "pauses", "parts", "words")


def transcript_words(transcript: DataFrame) -> DataFrame:
    """(rec_id, word_idx, text, start, end)."""
    x = transcript.select("rec_id", F.posexplode("words").alias("word_idx", "w"))
    return x.select("rec_id", "word_idx", F.get("w", F.lit(0)).alias("text"), F.get("w", F.lit(1)).cast("double").alias("start"), F.get("w", F.lit(2)).cast("double").alias("end"))


def json_tables(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row for each JSON file of a kind (scan, windows, picks), with rec_id; missing fields are null."""
    return spark.read.schema(FILES[kind]).option("multiLine", True).json(path).withColumn("rec_id", F.col("_metadata.file_name"))


def scan_tables(scans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, loud, hints) of scan files."""
    l = scans.select("rec_id", F.posexplode("lines").alias("idx", "l"))
    lines = l.select("rec_id", "idx", F.get("l", F.lit(0)).cast("double").alias("start"), F.get("l", F.lit(1)).cast("double").alias("end"), F.get("l", F.lit(2)).alias("text"))
    return lines, scans.select("rec_id", F.explode("loud").alias("x")).select("rec_id", "x.*"), scans.select("rec_id", F.explode("hints").alias("x")).select("rec_id", "x.*")


def probe_facts(probes: DataFrame) -> DataFrame:
    """(rec_id, format, duration, has_audio, has_video, has_cover, width, height, fps) of media descriptions (rec_id, probe: JSON text).

    The first real picture stream counts; one-frame cover art does not.  Widths are of square pixels, turned pictures swap sides.
    """
    stream = "struct<codec_type:string,width:string,height:string,sample_aspect_ratio:string,avg_frame_rate:string,r_frame_rate:string,disposition:struct<attached_pic:int>,tags:struct<rotate:string>,side_data_list:array<struct<rotation:string>>>"
    p = probes.select("rec_id", F.from_json("probe", f"struct<format:struct<format_name:string,duration:string>,streams:array<{stream}>>").alias("p"))
    streams = F.coalesce("p.streams", F.array().cast(f"array<{stream}>"))
    size = lambda s, c: F.coalesce(s[c].try_cast("double").cast("int"), F.lit(0))
    cover = lambda s: F.coalesce(s["disposition"]["attached_pic"] != 0, F.lit(False))
    real = F.try_element_at(F.filter(streams, lambda s: (s["codec_type"] == "video") & ~cover(s) & (size(s, "width") >= 16) & (size(s, "height") >= 16)), F.lit(1))
    x = p.withColumn("s", real)
    s = F.col("s")
    part = lambda c, at: F.split(c, ":", 2).getItem(at).try_cast("double")
    ratio = s["sample_aspect_ratio"]
    shape = F.when(F.coalesce(ratio, F.lit("")).contains(":") & (part(ratio, 0) > 0) & (part(ratio, 1) > 0), part(ratio, 0) / part(ratio, 1)).otherwise(1.0)
    turned = F.try_element_at(F.filter(F.coalesce(s["side_data_list"], F.array().cast("array<struct<rotation:string>>")), lambda d: d["rotation"].isNotNull()), F.lit(1))["rotation"]
    angle = F.when(turned.isNotNull(), F.coalesce(F.bround(turned.try_cast("double"), 0).cast("int"), F.lit(0))).otherwise(F.coalesce(s["tags"]["rotate"].try_cast("int"), F.lit(0)))
    w, h = F.bround(size(s, "width") * shape / 2, 0).cast("int") * 2, size(s, "height")
    swap = F.abs(angle) % 180 == 90
    fraction = lambda c: F.when(F.split(c, "/", 2).getItem(1).try_cast("double") != 0, F.split(c, "/", 2).getItem(0).try_cast("double") / F.split(c, "/", 2).getItem(1).try_cast("double"))
    rate = F.coalesce(*[F.when(s[c].contains("/"), fraction(s[c])) for c in ("avg_frame_rate", "r_frame_rate")], F.lit(0.0))
    seen = s.isNotNull()
    return x.select(
        "rec_id", F.coalesce("p.format.format_name", F.lit("")).alias("format"), F.coalesce(F.col("p.format.duration").try_cast("double"), F.lit(0.0)).alias("duration"),
        F.exists(streams, lambda t: t["codec_type"] == "audio").alias("has_audio"), seen.alias("has_video"), F.exists(streams, lambda t: (t["codec_type"] == "video") & cover(t)).alias("has_cover"),
        F.when(seen, F.when(swap, h).otherwise(w)).otherwise(0).alias("width"), F.when(seen, F.when(swap, w).otherwise(h)).otherwise(0).alias("height"), F.when(seen, rate).otherwise(0.0).alias("fps"),
    )


def usable_media(facts: DataFrame, least: float = 30.0, most: float = 8 * 3600.0, size: int = 8 << 30) -> DataFrame:
    """facts (has_audio, duration, bytes) with fault: why a file is no episode; null if it is one."""
    fault = F.when(~F.col("has_audio"), "no sound").when(F.col("duration") < least, "too short").when(F.col("duration") > most, "too long").when(F.col("bytes") > size, "too large")
    return facts.withColumn("fault", fault)


def render_faults(lengths: DataFrame, slack: float = 0.05) -> DataFrame:
    """lengths (video, audio, expected, in seconds) with fault: missing, or unlike each other or what was planned; null if sound."""
    off = (F.abs(F.col("video") - F.col("audio")) > slack) | (F.abs(F.col("video") - F.col("expected")) > slack)
    return lengths.withColumn("fault", F.when(F.col("video").isNull() | F.col("audio").isNull(), "missing").when(off, "lengths"))


def rewraps(media: DataFrame) -> DataFrame:
    """media (format, has_video, forced, ...) with rewrapped, the ending of the container that a file is put into without encoding it
    anew, null where it stays, and maps, its streams.  Formats without an index cannot be cut at a moment; pieces of a
    stream are always put into one.
    """
    indexed = F.lit(False)
    for name in INDEXED:
        indexed = indexed | F.coalesce("format", F.lit("")).contains(name)
    stays = ~F.coalesce("forced", F.lit(False)) & indexed
    streams = F.when(F.col("has_video"), F.array(F.lit("0:a:0"), F.lit("0:V:0"))).otherwise(F.array(F.lit("0:a:0")))
    return media.withColumn("rewrapped", F.when(~stays, F.when(F.col("has_video"), "mkv").otherwise("mka"))).withColumn("maps", F.when(stays, F.array().cast("array<string>")).otherwise(streams))


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title): the text of each page's title element, white space folded; null without one."""
    found = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1)
    return pages.select("page_id", F.nullif(F.trim(F.regexp_replace(found, r"\s+", " ")), F.lit("")).alias("title"))


def sound_levels(files: DataFrame, frame: float = 0.02, rate: int | None = 16000, channels: int | None = 1) -> DataFrame:
    """(rec_id, idx, db) from 16-bit WAV files (path, content), in decibels of full scale for each 20 ms.

    Files of another rate or number of channels are refused (None: any will do).  Files are read in pieces of five thousand frames, so memory does not grow with their length beyond the file itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with wave.open(io.BytesIO(content), "rb") as fh:
                    found = fh.getnchannels()
                    if fh.getsampwidth() != 2 or rate not in (None, fh.getframerate()) or channels not in (None, found):
                        raise ValueError(f"{path}: {found} channels of {8 * fh.getsampwidth()} bits at {fh.getframerate()} Hz")
                    step, at = int(fh.getframerate() * frame), 0
                    while raw := fh.readframes(step * 5000):
                        s = np.frombuffer(raw, np.int16).astype(np.float64)
                        s = s.reshape(-1, found).mean(1) if found > 1 else s
                        n = len(s) // step
                        if not n:
                            continue
                        power = (s[: n * step].reshape(n, step) ** 2).mean(1)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(at, at + n)), pa.array(10 * np.log10(power / 32768.0**2 + 1e-10))], names=["rec_id", "idx", "db"])
                        at += n

    return files.select("path", "content").mapInArrow(run, "rec_id string, idx long, db double")


def feed_items(feeds: DataFrame) -> DataFrame:
    """(feed, key, title, source, published) of RSS texts (feed, xml): items with a media link over http."""
    item = "STRUCT<title: STRING, guid: STRING, pubDate: STRING, enclosure: STRUCT<_url: STRING>>"
    raw = feeds.select("feed", F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<item\b.*?</item>"), F.lit(0))).alias("x")).select("feed", F.from_xml("x", item, {"rowTag": "item"}).alias("i"))
    link = F.trim(F.coalesce("i.enclosure._url", F.lit("")))
    guid = F.trim(F.coalesce("i.guid", link))
    stamp = F.coalesce(F.try_to_timestamp(F.regexp_replace("i.pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace("i.pubDate", r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")))
    title = F.trim(F.regexp_replace(F.coalesce("i.title", F.lit("Untitled episode")), r"\s+", " "))
    return raw.where(F.lower(link).rlike("^https?://")).select("feed", F.left(F.sha1(guid), F.lit(16)).alias("key"), title.alias("title"), link.alias("source"), stamp.alias("published"))


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c), with c computed once however often it is used."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def reply_items(reply: Column, key: str = "clips") -> Column:
    """The items of a model's reply (array of variants), which may be fenced or surrounded by talk, a list or an object that holds
    one under ``key``; null where there is no JSON.
    """
    def tried(c: Column) -> Column:
        # the parser stops after a first value; in a list of its own, what follows shows
        alone = F.try_variant_get(F.try_parse_json(F.when(c != "", F.concat(F.lit("["), c, F.lit("]")))), "$", "array<variant>")
        return _once(alone, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))

    def listed(whole: Column) -> Column:
        kind = F.schema_of_variant(whole)
        found = F.when(kind.startswith("OBJECT"), F.try_variant_get(whole, f"$.{key}", "array<variant>")).when(kind.startswith("ARRAY"), F.try_variant_get(whole, "$", "array<variant>"))
        return F.when(whole.isNotNull(), F.coalesce(found, F.array().cast("array<variant>")))

    def read(r: Column) -> Column:
        tries = [F.regexp_replace(r, r"^\s+|\s+$", ""), *[F.regexp_extract(r, p, 1) for p in (r"(?s)```(?:json)?\s*(.+?)```", r"(?s)(\{.*\})", r"(?s)(\[.*\])")]]
        return _once(F.coalesce(*map(tried, tries)), listed)

    return _once(reply, read)


def _whole(item: Column, name: str) -> Column:
    """A whole number as int() reads it: numbers are cut, text must be one."""
    def read(v: Column) -> Column:
        kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        said = _once(text, lambda t: F.when(t.rlike(r"^\s*[+-]?\d+\s*$"), F.regexp_replace(t, r"\s+", "").try_cast("double")))
        number = F.when(kind == "STRING", said).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        return number.try_cast("int")

    return _once(F.try_variant_get(item, f"$.{name}", "variant"), read)


def valid_items(replies: DataFrame) -> DataFrame:
    """(reply_id, pos, first, last, title, caption, hashtags, why, score) of the objects in replies whose two numbers are whole.

    A score that is missing or no number is 50; scores lie between 0 and 100.  Texts are one line of 80, 600 and 400 characters.
    Parsing takes far longer than reading, so replies are dealt to all cores even where their file is one split,
    and exploded with their nulls: Spark would parse again to filter them first.
    """
    from tempora.functions.text import clean_hashtags, one_line

    replies = replies.repartition(4 * replies.sparkSession.sparkContext.defaultParallelism, "reply_id")
    x = replies.select("reply_id", F.posexplode_outer(reply_items(F.col("reply"))).alias("pos", "x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    item, text = F.col("x"), lambda name: F.try_variant_get(F.col("x"), f"$.{name}", "string")
    score = F.coalesce(text("score").try_cast("double"), F.lit(50.0))
    x = x.select(
        "reply_id", "pos", _whole(item, "first").alias("first"), _whole(item, "last").alias("last"), one_line(text("title"), 80).alias("title"), one_line(text("caption"), 600).alias("caption"),
        clean_hashtags(F.try_variant_get(item, "$.hashtags", "array<string>")).alias("hashtags"), one_line(text("why"), 400).alias("why"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"),
    )
    return x.where("first is not null and last is not null")


def reply_windows(replies: DataFrame, lines: DataFrame, most: float = 300.0) -> DataFrame:
    """(rec_id, pos, start, end, score, why) of replies (rec_id, reply) that name lines (rec_id, idx, start, end) from first to last."""
    from tempora.functions.text import one_line

    x = replies.select("rec_id", F.posexplode(reply_items(F.col("reply"), "windows")).alias("pos", "x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    score = F.try_variant_get("x", "$.score", "variant")
    number = F.when(score.isNull(), 50.0).otherwise(F.try_variant_get("x", "$.score", "string").try_cast("double"))
    x = x.select("rec_id", "pos", _whole(F.col("x"), "first").alias("first"), _whole(F.col("x"), "last").alias("last"), number.alias("score"), one_line(F.try_variant_get("x", "$.reason", "string"), 240).alias("why"))
    a, b = lines.select("rec_id", F.col("idx").alias("first"), "start"), lines.select("rec_id", F.col("idx").alias("last"), "end")
    found = x.where("first <= last and score is not null").join(a, ["rec_id", "first"]).join(b, ["rec_id", "last"])
    return found.select("rec_id", "pos", "start", F.least("end", F.col("start") + most).alias("end"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score"))).alias("score"), "why")
