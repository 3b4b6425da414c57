"""Values on an edge, which must fall the same way as in the queries' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions import text as T
from tempora.functions.numbers import rounded
from tempora.operators import candidates as C
from tempora.operators import signal as L
from tempora.plans import adapters


def test_halves_are_rounded_as_the_double_lies(spark, duck):
    x = [50.00055, -1.24435, 120.45, 2.5, 0.00005]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(rounded("x", 4).alias("r")).collect()
    assert [r.r for r in got] == [duck.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in x]
    assert got[0].r == 50.0005


def test_words_have_ascii_edges(spark, duck):
    said = ["das ist bestätigt", "the best", "a bestial thing", "à brb"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(F.regexp_count("s", F.lit(T.ascii_edges(T.EXCITED))).alias("n")).collect()
    assert [r.n for r in got] == [1, 1, 0, 0] == [duck.execute("SELECT len(regexp_extract_all(?, ?))", [s, T.EXCITED]).fetchone()[0] for s in said]


def test_words_begin_at_whole_hundredths(spark):
    w = adapters._timed(spark.createDataFrame([("r", i) for i in (3, 6, 7, 12)], "rec_id string, word_idx int"))
    assert [r.start for r in w.collect()] == [1.05, 2.1, 2.45, 4.2]


def test_quantiles_between_values(spark, duck):
    rows = [("a", v) for v in (10.0, 20.0, 30.0, 100.0, 371.92, 469.64)] + [("b", 62.84 + i * 0.37) for i in range(57)] + [("c", 5.1)] * 4 + [("d", None), ("d", 7.0)]
    got = {r.k: (r.n, r.p, r.q) for r in L.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p": 0.95, "q": 0.15}).collect()}
    for k in "abcd":
        v = [x for key, x in rows if key == k and x is not None]
        assert got[k] == (len(v), *duck.execute("SELECT quantile_cont(x, 0.95), quantile_cont(x, 0.15) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [v]).fetchone())


def test_a_pick_of_the_longest_length_stays(spark):
    s = spark.createDataFrame([("r", 0, 0.0, 8.0), ("r", 1, 8.5, 16.511)], "rec_id string, idx int, start double, end double")
    late = s.withColumn("end", F.when(F.col("idx") == 1, 16.511000000000003).otherwise(F.col("end")))
    picks = spark.createDataFrame([("r", 0, 0, 1, "T", 9.0)], "rec_id string, pick_id int, first int, last int, title string, score double")
    assert [(r.last, r.score) for r in C.trimmed_back(picks, s, 5.01, 15.01).collect()] == [(1, 9.0)]
    assert [(r.last, r.score) for r in C.trimmed_back(picks, late, 5.01, 15.01).collect()] == [(0, 4.0)]


def test_words_are_dealt_once_for_sentences_and_clips(spark, data):
    from tempora.plans import desk, speech

    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert moved(speech.turn_sentences(spark, data)) == 1  # of turns; cuts are not joined to words
    one = moved(speech.clip_selected(spark, data))
    assert moved(speech.stitch_clock(spark, data)) <= one + 2
    assert moved(desk.comment_tables(spark, data)) <= one + 6  # no second and third run of the whole choice


def test_replies_are_parsed_once_and_by_all_cores(spark):
    from tempora.sources import readers as R

    replies = spark.range(1, numPartitions=1).select(F.col("id").alias("reply_id"), F.concat(F.lit('[{"first": 1, "last": "2", "x": '), F.col("id").cast("string"), F.lit("}, 3]")).alias("reply"))
    found = R.valid_items(replies)
    assert [(r.pos, r.first, r.last, r.score) for r in found.collect()] == [(0, 1, 2, 50.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 6 and "RepartitionByExpression" in plan


def test_words_are_dealt_once_for_captions(spark, data):
    from tempora.plans import speech

    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert moved(speech.caption_chunks(spark, data)) == 1  # of turns; captions are cut where they lie
    assert moved(speech.subtitle_events(spark, data)) == 2  # the same once more, for the lengths of recordings


def test_spaces_are_those_of_the_pattern(spark):
    c = spark.range(1, 0x10000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    got = c.select("c", (F.regexp_replace("c", f"^{T.SPACE}+|{T.SPACE}+$", "") == "").alias("old"), (T.stripped("c") == "").alias("new")).where("old or new").collect()
    assert len(got) == len(T.SPACES) and all(r.old and r.new for r in got)


def test_captions_and_their_words_agree(spark):
    from tempora.operators import segment as S
    from tempora.sources import sinks

    said = "one {two} “three”, four five-six seven. — eight; ... nine ten".split()
    w = spark.createDataFrame([("r", 2 * i, s, i * 0.4, i * 0.4 + 0.3) for i, s in enumerate(said)], "rec_id string, word_idx int, text string, start double, end double")
    ends = spark.createDataFrame([("r", 9.0)], "rec_id string, duration double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    chunks = S.caption_chunks(w, uppercase=False)
    assert [(r[1], r[2], r[3]) for r in rows(chunks)] == [(0, 0, "one"), (0, 1, "(two)"), (0, 2, "three”"), (1, 0, "four"), (1, 1, "five-six"), (1, 2, "seven"), (2, 0, "eight"), (3, 0, "nine"), (3, 1, "ten")]
    whole, parts = S.held_events(S.captions(w, uppercase=False), ends), S.caption_events(chunks, ends)
    assert whole.columns == parts.columns and rows(whole) == rows(parts)
    assert rows(sinks.subtitle_events(whole, 9))[5][3] == r"Dialogue: 0,0:00:02.00,0:00:02.65,Cap,,0,0,0,,{\an5\pos(540,9)}four five-six {\c&H00D4FF&}seven{\c&HFFFFFF&}"
