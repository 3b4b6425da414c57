"""Files written by the library and read back: sound, transcripts and the files of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.operators import temporal as M
from tempora.plans.adapters import TURN_LINES, TURN_WORDS, r4, registry, table, turn_lines, turn_words
from tempora.sources import readers as R
from tempora.sources import sinks
from tempora.sources.files import shared_folder, write_files
from tempora.sources.sound import sound_levels, stitched, wav_files

QUERIES, ORACLE_SQL, query = registry()

RATE, FRAME = 16000, 320


def _tapes(spark: SparkSession, sf_dir: str) -> str:
    """A folder of eight sound files: 20 ms for each event of every eighth user, as loud as its number."""
    e = table(spark, sf_dir, "events").where("user_id is not null").withColumn("tape", F.col("user_id") % 8)
    place = F.row_number().over(Window.partitionBy("tape").orderBy("user_id", "event_id")) - 1
    level = F.hex(F.col("event_id") * 37 % 30000)  # a sample, its low byte first
    sample = F.concat(F.substring(F.lpad(level, 4, "0"), 3, 2), F.substring(F.lpad(level, 4, "0"), 1, 2))
    blocks = e.select(F.format_string("tape%d.wav", "tape").alias("name"), place.cast("long").alias("seq"), F.unhex(sample).alias("content"))
    folder = shared_folder(spark, "tapes")
    sound = F.when(F.octet_length("content") == 2, F.unhex(F.repeat(F.hex("content"), FRAME))).otherwise(F.col("content"))  # heads are longer
    write_files(wav_files(blocks, RATE, FRAME), folder, sound)
    return folder


def _name(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^([^/]*)\.\w+$", 1)  # over a whole path the search begins anew at each character


TAPES = """tapes AS (SELECT 'tape' || (user_id % 8) AS tape, row_number() OVER (PARTITION BY user_id % 8 ORDER BY user_id, event_id) - 1 AS idx, CAST(event_id * 37 % 30000 AS DOUBLE) AS v FROM events WHERE user_id IS NOT NULL)"""


@query(f"""WITH {TAPES} SELECT tape, idx, round(10 * log10(v * v / 1073741824.0 + 1e-10), 4) AS db FROM tapes""")
def sound_file_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of eight sound files, each read by many tasks."""
    x = sound_levels(spark, _tapes(spark, sf_dir), frames_per_task=700)
    return x.select(_name(F.col("rec_id")).alias("tape"), "idx", r4("db").alias("db"))


# Two stretches of each tape, the second of which begins before the first; a second of silence between; a tape may run out.
@query(f"""WITH {TAPES}, names AS (SELECT DISTINCT tape FROM tapes), src AS (SELECT tape, i AS idx, CASE WHEN i < 40 THEN i + 25 WHEN i < 90 THEN -1 ELSE i - 85 END AS k FROM names, range(140) r(i))
SELECT 'mix-' || s.tape AS tape, s.idx, round(10 * log10(coalesce(t.v * t.v, 0) / 1073741824.0 + 1e-10), 4) AS db FROM src s LEFT JOIN tapes t ON t.tape = s.tape AND t.idx = s.k""")
def stitched_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of sound files stitched from stretches of others."""
    folder, out = _tapes(spark, sf_dir), shared_folder(spark, "mixes")
    paths = spark.range(8).select(F.format_string("tape%d", "id").alias("rec_id"), F.concat(F.lit(f"{folder}/"), F.format_string("tape%d.wav", "id")).alias("path"))
    there = table(spark, sf_dir, "events").where("user_id is not null").select(F.format_string("tape%d", F.col("user_id") % 8).alias("rec_id")).distinct()
    items = there.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select("rec_id", F.col("i").alias("idx"), F.when(F.col("i") == 0, 0.5).otherwise(0.1).alias("offset"), F.when(F.col("i") == 0, 0.8).otherwise(1.0).alias("length"))
    plan = M.stitch_plan(items, RATE).join(paths, "rec_id").withColumn("name", F.concat(F.lit("mix-"), "rec_id", F.lit(".wav")))
    write_files(stitched(plan, RATE, block=0.3), out)
    return sound_levels(spark, out).select(_name(F.col("rec_id")).alias("tape"), "idx", r4("db").alias("db"))


@query(f"""WITH {TURN_WORDS} SELECT rec_id, word_idx, text, round(start, 3) AS start, round("end", 3) AS "end" FROM turn_words WHERE rec_id % 5 = 0""")
def transcript_file_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every fifth conversation, written as transcript files and read back."""
    w = turn_words(spark, sf_dir).where("rec_id % 5 = 0")
    facts = w.groupBy("rec_id").agg(F.max("end").alias("duration")).select("rec_id", F.lit("en").alias("language"), "duration", F.lit("small").alias("model"))
    text = sinks.transcript_json(w, w.select("rec_id", "word_idx", F.lit(0.4).alias("length")), facts)
    folder = shared_folder(spark, "transcripts")
    write_files(text.select(F.concat(F.col("rec_id").cast("string"), F.lit(".json")).alias("name"), F.lit(0).alias("seq"), F.encode("json", "UTF-8").alias("content")), folder)
    read = R.transcript_words(R.transcripts(spark, folder))
    return read.select(F.regexp_extract("rec_id", r"(\d+)\.json", 1).cast("long").alias("rec_id"), "word_idx", "text", "start", "end")


@query(f"""WITH {TURN_LINES} SELECT rec_id, idx, round(start, 2) AS start, round("end", 2) AS "end", text FROM turn_lines WHERE rec_id % 7 = 0""")
def scan_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every seventh conversation, written as files of a first pass and read back."""
    lines = turn_lines(spark, sf_dir).where("rec_id % 7 = 0")
    row = F.to_json(F.array(F.round("start", 2).cast("string"), F.round("end", 2).cast("string"), F.col("text")))
    per = lines.groupBy("rec_id").agg(sinks.in_order("idx", row, ",").alias("body"))
    text = F.concat(F.lit('{"meta":{"title":"","duration":1.0},"lines":['), "body", F.lit('],"loud":[],"hints":[]}'))
    folder = shared_folder(spark, "scans")
    write_files(per.select(F.concat(F.col("rec_id").cast("string"), F.lit(".json")).alias("name"), F.lit(0).alias("seq"), F.encode(text, "UTF-8").alias("content")), folder)
    found = R.scan_tables(R.json_tables(spark, folder, "scan"))[0]
    return found.select(F.regexp_extract("rec_id", r"(\d+)\.json", 1).cast("long").alias("rec_id"), "idx", "start", "end", "text")
