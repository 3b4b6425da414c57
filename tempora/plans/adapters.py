"""The standard tables seen as recordings, with the same views as SQL, and the decorator that registers queries."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.numbers import rounded

Query = Callable[[SparkSession, str], DataFrame]
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """(queries, their SQL, decorator) of one module; the decorator takes the SQL, or None where SQL cannot say it."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(text: str | None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A standard table; Python workers can import this package from here on."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(c: Column | str) -> Column:
    return rounded(c, 4)


def _timed(words: DataFrame) -> DataFrame:
    """Words said 0.35 s apart, with a longer gap after every 37th; 0.35 is no double, hundredths are whole."""
    i = F.col("word_idx")
    start = 35 * i / 100 + 1.2 * F.floor(i / 37)
    return words.withColumn("start", start).withColumn("end", start + 0.30)


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, word_idx, text, start, end): every word of every document."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    words = docs.select(F.col("doc_id").alias("rec_id"), F.posexplode(F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda w: w != "")).alias("word_idx", "text"))
    return _timed(words)


def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, word_idx, text, start, end): every word of every conversation, its turns one after another."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and text is not null")
    turns = turns.select(F.col("conv_id").alias("rec_id"), F.col("turn").cast("long").alias("turn"), F.filter(F.split("text", "[ \\t\\r\\n]+"), lambda w: w != "").alias("w"))
    before = F.coalesce(F.sum(F.size("w")).over(Window.partitionBy("rec_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    words = turns.withColumn("before", before).select("rec_id", "before", F.posexplode("w").alias("pos", "text"))
    return _timed(words.select("rec_id", (F.col("before") + F.col("pos")).cast("int").alias("word_idx"), "text"))


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, idx, start, end, text): the turns of every conversation as lines, twelve characters a second, half a second apart."""
    w = Window.partitionBy("rec_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and text is not null").select(F.col("conv_id").alias("rec_id"), F.col("turn").cast("long").alias("turn"), "text")
    long = F.char_length("text") / 12.0
    start = F.coalesce(F.sum(long + 0.5).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return turns.select("rec_id", (F.row_number().over(w) - 1).alias("idx"), start.alias("start"), (start + long).alias("end"), "text")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, idx, db): the values of each user's events, in order."""
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(F.col("user_id").alias("rec_id"), (F.row_number().over(w) - 1).alias("idx"), F.col("value").alias("db"))


def moments(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """(rec_id, id, t, kind, value): events on their user's clock, in seconds of the first of January 2024."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    out = e.select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("id"), rounded(t, 3).alias("t"), F.col("event_type").alias("kind"), "value")
    return out if kind is None else out.where(F.col("kind") == kind)


DOCUMENT_WORDS = r"""document_words AS (
  SELECT rec_id, CAST(i - 1 AS INTEGER) AS word_idx, text, 0.35 * (i - 1) + 1.2 * floor((i - 1) / 37) AS start, 0.35 * (i - 1) + 1.2 * floor((i - 1) / 37) + 0.30 AS "end"
  FROM (SELECT doc_id AS rec_id, unnest(w) AS text, generate_subscripts(w, 1) AS i
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)))"""

TURN_WORDS = r"""turn_words AS (
  SELECT rec_id, CAST(n AS INTEGER) AS word_idx, text, 0.35 * n + 1.2 * floor(n / 37) AS start, 0.35 * n + 1.2 * floor(n / 37) + 0.30 AS "end"
  FROM (SELECT conv_id AS rec_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS n
        FROM (SELECT conv_id, turn, unnest(w) AS text, generate_subscripts(w, 1) AS i
              FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL))))"""

TURN_LINES = r"""turn_lines AS (
  SELECT conv_id AS rec_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx, "at" AS start, "at" + length(text) / 12.0 AS "end", text
  FROM (SELECT *, coalesce(sum(length(text) / 12.0 + 0.5) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS "at"
        FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL))"""

LEVELS = """levels AS (
  SELECT user_id AS rec_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS idx, value AS db FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"""

MOMENTS = """moments AS (
  SELECT user_id AS rec_id, event_id AS id, round(epoch_us(ts) / 1e6 - 1704067200, 3) AS t, event_type AS kind, value FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""


def quoted(words: list[str]) -> str:
    """A list of SQL text values."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
