"""Clip edges, chunks, parts, shots, cameras and plans for pictures and sound, over events, conversations and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import geometry as G
from tempora.operators import framing as V
from tempora.operators import segment as S
from tempora.operators import signal as L
from tempora.operators import temporal as M
from tempora.plans.adapters import LEVELS, TURN_WORDS, levels, r4, registry, table, turn_words
from tempora.plans.signals import EVEN, ISLANDS, PIECES, TWO, _parts, _pictures, _pieces, _silences
from tempora.plans.speech import IS_END
from tempora.plans.work import PIECES as PLAYLISTS
from tempora.plans.work import _pieces as _playlists
from tempora.sources import sinks

QUERIES, ORACLE_SQL, query = registry()


@query(f"""WITH {ISLANDS}, whole AS (SELECT rec_id, CAST(max(idx) + 1 AS DOUBLE) AS total FROM levels GROUP BY rec_id),
w AS (SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY idx) - 1 AS INTEGER) AS k, idx + CAST(0.1 AS DOUBLE) AS s, idx + CAST(0.4 AS DOUBLE) AS e FROM levels WHERE db > 60),
n AS (SELECT *, coalesce(lag(e) OVER v, 0.0) AS before, lead(s) OVER v AS nxt FROM w WINDOW v AS (PARTITION BY rec_id ORDER BY k)),
c AS (SELECT h.rec_id, h.k AS first, t.k AS last, h.s AS hs, h.e AS he, h.before, t.s AS ts, t.e AS te, coalesce(t.nxt, d.total) AS nxt, d.total FROM n h JOIN n t ON t.rec_id = h.rec_id AND t.k = h.k + 2 JOIN whole d ON d.rec_id = h.rec_id WHERE h.k % 3 = 0),
pause AS (SELECT rec_id, CAST(first AS DOUBLE) AS a, CAST(last + 1 AS DOUBLE) AS b FROM silent),
onset AS (SELECT c.rec_id, c.first, arg_min(greatest(q.a + 0.02, q.b - 0.10), abs(q.b - hs)) AS z FROM c JOIN pause q ON q.rec_id = c.rec_id AND q.b BETWEEN hs - 0.45 AND hs + 0.20 GROUP BY c.rec_id, c.first),
offs AS (SELECT c.rec_id, c.first, arg_min(least(q.a + 0.30, q.b - 0.02), q.a) AS z FROM c JOIN pause q ON q.rec_id = c.rec_id AND q.a BETWEEN ts + 0.05 AND te + 0.45 AND q.a <= nxt + 0.2 GROUP BY c.rec_id, c.first),
raw AS (SELECT c.*, coalesce(o.z, hs - least(0.10, greatest(hs - before, 0.0) / 2)) AS a0, coalesce(p.z, te + least(0.15, greatest(nxt - te, 0.0) / 2)) AS b0 FROM c LEFT JOIN onset o ON o.rec_id = c.rec_id AND o.first = c.first LEFT JOIN offs p ON p.rec_id = c.rec_id AND p.first = c.first),
late AS (SELECT r.rec_id, r.first, max(q.b) - 0.10 AS z FROM raw r JOIN pause q ON q.rec_id = r.rec_id AND q.a <= a0 + 0.05 AND a0 + 0.15 < q.b AND q.b < ts GROUP BY r.rec_id, r.first),
early AS (SELECT r.rec_id, r.first, min(q.a) + 0.30 AS z FROM raw r JOIN pause q ON q.rec_id = r.rec_id AND he < q.a AND q.a < b0 - 0.35 AND q.b >= b0 - 0.05 GROUP BY r.rec_id, r.first),
edged AS (SELECT r.rec_id, r.first, r.last, total, greatest(0.0, coalesce(l.z, a0)) AS a, coalesce(e.z, b0) AS b FROM raw r LEFT JOIN late l ON l.rec_id = r.rec_id AND l.first = r.first LEFT JOIN early e ON e.rec_id = r.rec_id AND e.first = r.first)
SELECT rec_id, first, last, round(a, 4) AS start, round(greatest(least(total, b), a + 0.5), 4) AS "end" FROM edged""")
def snap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of three loud frames each, their edges moved into the quiet runs around them."""
    x = levels(spark, sf_dir)
    order = F.row_number().over(Window.partitionBy("rec_id").orderBy("idx")) - 1
    words = x.where("db > 60").select("rec_id", order.alias("word_idx"), (F.col("idx") + 0.1).alias("start"), (F.col("idx") + 0.4).alias("end"))
    clips = words.where("word_idx % 3 = 0").select("rec_id", F.col("word_idx").alias("clip"), F.col("word_idx").alias("first"), (F.col("word_idx") + 2).alias("last"))
    ends = x.groupBy("rec_id").agg((F.max("idx") + 1.0).alias("duration"))
    return M.snapped(clips, words, _silences(spark, sf_dir), ends).select("rec_id", "first", "last", r4("start").alias("start"), r4("end").alias("end"))


@query(f"""WITH RECURSIVE {LEVELS}, v AS (SELECT rec_id, list(db ORDER BY idx) AS v, count(*) + CAST(0.4 AS DOUBLE) AS n FROM levels GROUP BY rec_id),
walk AS (
  SELECT rec_id, v, n, 0 AS chunk, CAST(0 AS DOUBLE) AS a, CASE WHEN 20 >= n THEN n ELSE 14 + list_position(v[15:20], list_min(v[15:20])) - CAST(0.5 AS DOUBLE) END AS b FROM v
  UNION ALL
  SELECT rec_id, v, n, chunk + 1, b, CASE WHEN b + 20 >= n THEN n ELSE lo + list_position(v[lo + 1:lo + 6], list_min(v[lo + 1:lo + 6])) - CAST(0.5 AS DOUBLE) END FROM (SELECT *, CAST(floor(b + 20) AS BIGINT) - 6 AS lo FROM walk WHERE b < n)
) SELECT rec_id, CAST(chunk AS INTEGER) AS chunk, a AS start, b AS "end" FROM walk""")
def chunk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series, which ends 0.4 s after its last whole second, in chunks of about twenty seconds that end where it is quiet."""
    x = levels(spark, sf_dir)
    ends = x.groupBy("rec_id").agg((F.count("*") + 0.4).alias("duration"))
    return L.chunk_edges(x.select("rec_id", F.col("idx").alias("sec"), "db"), 20, 6, ends)


PARTS = """parts AS (SELECT rec_id, k AS idx, k * 20.0 AS start, k * 20.0 + 19 AS "end", k * 15.0 AS origin FROM (SELECT DISTINCT rec_id FROM turn_words), range(3) r(k))"""
OWNED = f"""{TURN_WORDS}, {PARTS}, met AS (SELECT w.*, p.idx, NOT (p.start <= w.start AND w.start < p."end") AS out_, least(abs(p.start - w.start), abs(p."end" - w.start)) AS far FROM turn_words w JOIN parts p USING (rec_id)),
owned AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY rec_id, word_idx ORDER BY out_, CASE WHEN out_ THEN far ELSE 0 END, idx) = 1)"""


@query(f"""WITH {OWNED} SELECT rec_id, word_idx, CAST(idx AS INTEGER) AS part_idx, coalesce(lead(idx) OVER (PARTITION BY rec_id ORDER BY word_idx) <> idx, false) AS part_end FROM owned""")
def part_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word of each part."""
    return M.part_breaks(turn_words(spark, sf_dir), _parts(spark, sf_dir)).select("rec_id", "word_idx", "part_idx", "part_end")


@query(f"""WITH {OWNED}, f AS (SELECT *, (lead(start) OVER w IS NULL OR {IS_END} OR coalesce(lead(start) OVER w - "end" >= 1.0, false) OR coalesce(lead(idx) OVER w <> idx, false)) AS stop FROM owned WINDOW w AS (PARTITION BY rec_id ORDER BY word_idx)),
u AS (SELECT *, coalesce(sum(CAST(stop AS INTEGER)) OVER (PARTITION BY rec_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS unit FROM f)
SELECT rec_id, CAST(unit AS BIGINT) AS unit, count(*) AS n_words, min(word_idx) AS first FROM u GROUP BY rec_id, unit""")
def part_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of words that never run on from one part into the next."""
    u = S.hard_units(turn_words(spark, sf_dir), parts=_parts(spark, sf_dir))
    return u.groupBy("rec_id", "unit").agg(F.count("*").alias("n_words"), F.min("word_idx").alias("first"))


@query(f"""WITH {TURN_WORDS}, {PARTS} SELECT rec_id, word_idx, text FROM turn_words w WHERE EXISTS (SELECT 1 FROM parts p WHERE p.rec_id = w.rec_id AND p.start <= w.start AND w."end" <= p."end" + 0.05)""")
def words_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that lie whole in a part."""
    return M.words_inside(turn_words(spark, sf_dir), _parts(spark, sf_dir)).select("rec_id", "word_idx", "text")


@query(f"""WITH {PIECES}, n AS (SELECT rec_id, piece, start, CAST(round_even(("end" - start) * 16000, 0) AS BIGINT) AS n FROM pieces), p AS (SELECT *, coalesce(sum(n + 16000) OVER (PARTITION BY rec_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM n)
SELECT rec_id, CAST(piece AS INTEGER) AS idx, CAST(round_even(start * 16000, 0) AS BIGINT) AS src_frame, CAST(d AS BIGINT) AS dst_frame, n, round(d / 16000, 4) AS start, round((d + n) / 16000, 4) AS "end" FROM p""")
def stitch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sound of each piece goes when they are laid end to end."""
    items = _pieces(spark, sf_dir)[1].select("rec_id", F.col("piece").alias("idx"), F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"))
    return M.stitch_plan(items).select("rec_id", "idx", "src_frame", "dst_frame", "n", r4("start").alias("start"), r4("end").alias("end"))


FRAMES = f"""{PIECES}, frames AS (SELECT * FROM (SELECT rec_id, piece, CAST(round_even(start * 30, 0) AS BIGINT) AS first, CAST(round_even("end" * 30, 0) AS BIGINT) AS last FROM pieces) WHERE last - first >= 2)"""


@query(f"""WITH {FRAMES} SELECT rec_id, CAST(piece AS INTEGER) AS piece, first, last FROM frames""")
def kept_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each clip in whole frames."""
    return M.kept_frames(_pieces(spark, sf_dir)[1]).select("rec_id", "piece", "first", "last")


HEAD = "[0:a:0]aresample=48000,aformat=sample_fmts=fltp:channel_layouts=stereo,apad=pad_dur=1.5"


GAIN = "CASE WHEN lufs > -70 AND lufs < 0 THEN greatest(-20.0, least(20.0, -14.0 - lufs)) ELSE 0.0 END"


@query(f"""WITH {FRAMES}, o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY piece) - 1 AS i, count(*) OVER (PARTITION BY rec_id) AS n FROM frames),
c AS (SELECT *, printf('atrim=start=%.5f:end=%.5f,asetpts=PTS-STARTPTS', CAST(first AS DOUBLE) / 30, CAST(last AS DOUBLE) / 30) || CASE WHEN i > 0 THEN ',afade=t=in:st=0:d=0.008' ELSE '' END || CASE WHEN i < n - 1 THEN printf(',afade=t=out:st=%.5f:d=0.008', greatest(0.0, CAST(last - first AS DOUBLE) / 30 - 0.008)) ELSE '' END AS chain FROM o),
per AS (SELECT rec_id, CASE WHEN any_value(n) = 1 THEN '{HEAD},' || any_value(chain) || '[acat]' ELSE '{HEAD},asplit=' || any_value(n) || string_agg('[a' || i || ']', '' ORDER BY i) || ';' || string_agg('[a' || i || ']' || chain || '[q' || i || ']', ';' ORDER BY i) || ';' || string_agg('[q' || i || ']', '' ORDER BY i) || printf('concat=n=%d:v=0:a=1[acat]', any_value(n)) END AS graph FROM c GROUP BY rec_id),
loud AS (SELECT rec_id, -(rec_id % 90) * 0.75 - 5.5 AS lufs FROM per)
SELECT rec_id, CAST(0 AS INTEGER) AS clip, graph || ';[acat]volume=' || printf('%.2f', CAST({GAIN} AS DOUBLE)) || 'dB,alimiter=limit=0.84:attack=5:release=50:level=false:latency=1,aresample=48000' || CASE WHEN rec_id % 2 = 1 THEN ',asplit=2[aout][aw]' ELSE '[aout]' END AS graph FROM per JOIN loud USING (rec_id)""")
def sound_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter graph that joins and levels the sound of each clip's frames; every other clip's sound is drawn too."""
    frames = M.kept_frames(_pieces(spark, sf_dir)[1])
    clips = frames.select("rec_id", "clip").distinct().withColumn("lufs", -(F.col("rec_id") % 90) * 0.75 - 5.5).withColumn("wave", F.col("rec_id") % 2 == 1)
    return sinks.sound_graphs(frames, L.steady_gain(clips))


# Two clips of each recording: the second's frames are seven later, and its layouts change every three seconds, not eight.
LAID = f"""{FRAMES}, kept AS (SELECT rec_id, CAST(0 AS INTEGER) AS clip, first, last FROM frames UNION ALL SELECT rec_id, 1, first + 7, last + 7 FROM frames),
steps AS (SELECT rec_id, CAST(0 AS INTEGER) AS clip, idx // 4 AS s, idx // 8 % 3 AS k, min(idx) * 30 AS sa, (max(idx) + 1) * 30 AS sb FROM levels GROUP BY ALL UNION ALL SELECT rec_id, 1, idx // 3, idx // 3 % 3, min(idx) * 30, (max(idx) + 1) * 30 FROM levels GROUP BY ALL),
segs AS (SELECT rec_id, clip, sa, sb, CASE WHEN k = 2 THEN 'fit' ELSE 'crop' END AS kind, CASE k WHEN 0 THEN 0.2 WHEN 1 THEN 0.8 END AS cx FROM steps),
hit AS (SELECT k.rec_id, k.clip, first AS fa, last AS fb, greatest(first, sa) AS a, least(last, sb) AS b, kind, cx FROM kept k JOIN segs s ON s.rec_id = k.rec_id AND s.clip = k.clip AND least(last, sb) - greatest(first, sa) >= 1),
stepped AS (SELECT *, CASE WHEN lag(b) OVER w = a AND lag(kind) OVER w = kind AND lag(cx) OVER w IS NOT DISTINCT FROM cx THEN 0 ELSE 1 END AS new FROM hit WINDOW w AS (PARTITION BY rec_id, clip ORDER BY a)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY rec_id, clip ORDER BY a) AS run FROM stepped),
joined AS (SELECT rec_id, clip, run, min(a) AS a, max(b) AS b, any_value(kind) AS kind, any_value(cx) AS cx FROM numbered GROUP BY rec_id, clip, run),
inside AS (SELECT k.rec_id, k.clip, k.first AS fa, CASE WHEN row_number() OVER (PARTITION BY k.rec_id, k.clip, k.first ORDER BY a) = 1 THEN k.first ELSE a END AS first, CASE WHEN row_number() OVER (PARTITION BY k.rec_id, k.clip, k.first ORDER BY a DESC) = 1 THEN k.last ELSE b END AS last, kind, cx
  FROM kept k JOIN joined j ON j.rec_id = k.rec_id AND j.clip = k.clip AND a >= k.first AND a < k.last),
laid AS (SELECT rec_id, clip, first, last, kind, CAST(cx AS DOUBLE) AS cx FROM inside UNION ALL SELECT rec_id, clip, first, last, 'fit', NULL FROM kept k WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.rec_id = k.rec_id AND i.clip = k.clip AND i.fa = k.first))"""


def _laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, frames = levels(spark, sf_dir), M.kept_frames(_pieces(spark, sf_dir)[1]).select("rec_id", "first", "last")
    kept = frames.withColumn("clip", F.lit(0)).unionByName(frames.select("rec_id", (F.col("first") + 7).alias("first"), (F.col("last") + 7).alias("last"), F.lit(1).alias("clip")))

    def steps(clip: int, length: int, turn: int) -> DataFrame:
        per = x.groupBy("rec_id", F.floor(F.col("idx") / length).alias("s"), (F.floor(F.col("idx") / turn) % 3).alias("k")).agg(F.min("idx").cast("double").alias("start"), (F.max("idx") + 1.0).alias("end"))
        framing = F.when(F.col("k") < 2, F.struct(F.when(F.col("k") == 0, 0.2).otherwise(0.8).alias("cx")))
        return per.select("rec_id", F.lit(clip).alias("clip"), "start", "end", F.when(F.col("k") == 2, "fit").otherwise("crop").alias("kind"), framing.alias("framing"))

    return M.cut_segments(kept, steps(0, 4, 8).unionByName(steps(1, 3, 3)))


@query(f"""WITH {LAID} SELECT * FROM laid""")
def layout_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of each layout of two clips; windows on two people are two layouts."""
    return _laid(spark, sf_dir).select("rec_id", "clip", "first", "last", "kind", F.col("framing.cx").alias("cx"))


@query(f"""WITH {LAID}, o AS (SELECT *, row_number() OVER (PARTITION BY rec_id, clip ORDER BY first) - 1 AS i, count(*) OVER (PARTITION BY rec_id, clip) AS n FROM laid),
c AS (SELECT *, printf('[v%d]trim=start_frame=%d:end_frame=%d,setpts=PTS-STARTPTS,', i, first, last) || CASE WHEN kind = 'crop' THEN printf('crop=608:1080:%d:0,scale=1080:1920:flags=bicubic,setsar=1', CASE WHEN cx < 0.5 THEN 80 ELSE 1232 END)
  ELSE printf('split=2[s%da][s%db];[s%da]@BLUR[s%dg];[s%db]scale=1080:608:flags=bicubic[s%df];[s%dg][s%df]overlay=(W-w)/2:(H-h)/2,setsar=1', i, i, i, i, i, i, i, i) END || CASE WHEN n > 1 THEN printf('[p%d]', i) ELSE '[vcat]' END AS piece FROM o)
SELECT rec_id, clip, '[0:V:0]fps=30:start_time=0,tpad=stop_mode=clone:stop_duration=1.5,scale=1920:1080:flags=bicubic,format=yuv420p,setsar=1' || CASE WHEN any_value(n) = 1 THEN '[v0];' || any_value(piece)
  ELSE ',split=' || any_value(n) || string_agg('[v' || i || ']', '' ORDER BY i) || ';' || string_agg(piece, ';' ORDER BY i) || ';' || string_agg('[p' || i || ']', '' ORDER BY i) || printf('concat=n=%d:v=1:a=0[vcat]', any_value(n)) END AS chain FROM c GROUP BY rec_id, clip""".replace("@BLUR", "scale=270:480:force_original_aspect_ratio=increase,crop=270:480,boxblur=10:2,scale=1080:1920:flags=bilinear,eq=brightness=-0.12:saturation=0.9"))
def cut_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter graph that cuts, lays out and joins the picture of each clip."""
    width, height = F.lit(1920), F.lit(1080)
    x = _laid(spark, sf_dir).withColumn("width", width).withColumn("height", height)
    x = x.withColumn("c", G.crop_box(F.col("framing.cx"), F.lit(None).cast("double"), F.lit(None).cast("double"), width, height))
    whole = G.fit_box(F.lit(0.5), F.lit(None).cast("double"), F.lit(None).cast("double"), width, height)
    box = F.when(F.col("kind") == "crop", G.box(*[F.col(f"c.{n}").cast("int") for n in "whxy"])).otherwise(whole)
    inner = G.even(F.lit(1080.0) * height / width)
    return sinks.video_chains(x, lambda tag: G.layout_graph(F.col("kind"), box, box, inner, F.lit(True), tag))


@query("""SELECT o_orderkey AS rec_id, CAST(1 AS INTEGER) AS clip, CASE WHEN o_orderkey % 3 = 0 THEN '[1:v]fps=30,format=yuv420p,split=2[c1][c2];[c1]scale=270:480:force_original_aspect_ratio=increase,crop=270:480,boxblur=12:2,scale=1080:1920:flags=bilinear,eq=brightness=-0.22:saturation=0.85[bg];[c2]scale=640:640:force_original_aspect_ratio=increase,crop=640:640[art];[bg][art]overlay=(W-w)/2:300[base];[aw]showwaves=s=960x280:mode=cline:rate=30:colors=0xFFD400:scale=sqrt:draw=full,format=yuva420p[wave];[base][wave]overlay=(W-w)/2:1000:shortest=1,trim=duration='
|| printf('%.3f', round(o_totalprice) / 7) || ',setsar=1[vcat]' ELSE 'color=c=0x12161c:s=1080x1920:r=30:d=' || printf('%.3f', round(o_totalprice) / 7) || '[base];[aw]showwaves=s=960x280:mode=cline:rate=30:colors=0xFFD400:scale=sqrt:draw=full,format=yuva420p[wave];[base][wave]overlay=(W-w)/2:700:shortest=1,setsar=1[vcat]' END AS chain FROM orders""")
def audiograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture of sound-only clips as long as a seventh of an order's price, every third with a cover."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), F.lit(1).alias("clip"), (F.round("o_totalprice") / 7).alias("duration"), (F.col("o_orderkey") % 3 == 0).alias("cover"), F.lit("#FFD400").alias("colour"))
    return sinks.audiogram_chains(o)


@query("""WITH t AS (SELECT o_custkey AS rec_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderkey % 7 <> 3)
SELECT rec_id, CASE WHEN any_value(n) = 1 THEN '[0:v]scale=360:640,setsar=1[sheet]' ELSE string_agg('[' || i || ':v]scale=360:640,setsar=1[t' || i || ']', ';' ORDER BY i) || ';' || string_agg('[t' || i || ']', '' ORDER BY i) || 'xstack=inputs=' || any_value(n) || ':layout='
|| string_agg((i % least(5, n)) * 368 || '_' || (i // least(5, n)) * 648, '|' ORDER BY i) || ':fill=black[sheet]' END AS graph FROM t GROUP BY rec_id""")
def contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of each customer's orders, some of which have no picture."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec_id"), F.col("o_orderkey").alias("rank"), F.when(F.col("o_orderkey") % 7 != 3, F.format_string("%d.jpg", "o_orderkey")).alias("file"))
    return sinks.contact_sheets(o)


@query(f"""WITH {PLAYLISTS}, r AS (SELECT list_id, run, min(start) AS a, max(start + duration) AS b FROM pieces WHERE start < 300 GROUP BY list_id, run HAVING max(start + duration) - min(start) >= 5),
s AS (SELECT *, CAST(round_even(a * 100, 0) AS BIGINT) AS x, CAST(round_even(b * 100, 0) AS BIGINT) AS y FROM r), t AS (SELECT *, greatest(x, coalesce(max(y) OVER (PARTITION BY list_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS d FROM s)
SELECT list_id, run, d AS dst_frame, greatest(y - d, 0) AS n FROM t""")
def sound_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that each run of a playlist takes, a hundred a second, in its first five minutes."""
    return M.sound_plan(_playlists(spark, sf_dir), 300.0, rate=100)


@query(f"""WITH {LEVELS}, f AS (SELECT rec_id, CAST(0.2 AS DOUBLE) + (idx % 3) * CAST(0.013 AS DOUBLE) + (rec_id % 4) * CAST(0.047 AS DOUBLE) * (idx % 2) AS c1, db / 2000 AS h2 FROM levels),
g AS (SELECT *, h2 >= 0.03 AS two, h2 >= 0.03 AND h2 > 0.1 AS second FROM f),
m AS (SELECT rec_id, CASE WHEN second THEN 0.5 ELSE c1 END AS cx, CASE WHEN second THEN 0.5 ELSE 0.8 END AS cy, CASE WHEN second THEN 0.1 ELSE 0.05 END AS w, CASE WHEN second THEN h2 ELSE 0.1 END AS h,
  second AND h2 > 0.2 AS crowded, NOT (second AND h2 > 0.2) AND CASE WHEN second THEN 0.1 < 0.6 * h2 ELSE NOT (two AND h2 >= 0.6 * CAST(0.1 AS DOUBLE)) END AS found FROM g),
ok AS (SELECT rec_id FROM m GROUP BY rec_id HAVING count(*) FILTER (found) >= 0.5 * count(*) AND count(*) FILTER (crowded) <= 0.25 * count(*)),
mid AS (SELECT rec_id, quantile_cont(cx, 0.5) AS cx, quantile_cont(CAST(cy AS DOUBLE), 0.5) AS cy, quantile_cont(CAST(w AS DOUBLE), 0.5) AS w, quantile_cont(CAST(h AS DOUBLE), 0.5) AS h FROM m JOIN ok USING (rec_id) WHERE found GROUP BY rec_id)
SELECT d.rec_id, round(d.cx, 6) AS cx, round(d.cy, 6) AS cy, round(d.w, 6) AS w, round(d.h, 6) AS h FROM mid d JOIN m USING (rec_id) WHERE found GROUP BY d.rec_id, d.cx, d.cy, d.w, d.h HAVING count(*) FILTER (abs(m.cx - d.cx) < 0.05 AND abs(m.cy - d.cy) < 0.06) >= 0.8 * count(*)""")
def camera_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with one small face that stays put."""
    face = lambda cx, cy, w, h, s: F.struct(cx.alias("cx"), F.lit(cy).alias("cy"), F.lit(w).alias("w"), h.alias("h"), F.lit(s).alias("score"))
    c1 = 0.2 + (F.col("idx") % 3) * 0.013 + (F.col("rec_id") % 4) * 0.047 * (F.col("idx") % 2)
    faces = F.array(face(c1, 0.8, 0.05, F.lit(0.1), 0.9), face(F.lit(0.5), 0.5, 0.1, F.col("db") / 2000, 0.8))
    boxes = V.camera_boxes(levels(spark, sf_dir).select("rec_id", F.col("idx").alias("t"), faces.alias("faces")))
    return boxes.select("rec_id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "w", "h")])


SHOTS = f"""{LEVELS}, cut AS (SELECT rec_id, idx * CAST(0.2 AS DOUBLE) AS t, row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS k FROM levels WHERE db / 500 >= 0.1), dur AS (SELECT rec_id, max(idx) * CAST(0.2 AS DOUBLE) + 1 AS d FROM levels GROUP BY rec_id),
edge_walk AS (SELECT rec_id, CAST(0 AS BIGINT) AS k, CAST([0.0] AS DOUBLE[]) AS e, d FROM dur UNION ALL
  SELECT w.rec_id, c.k, CASE WHEN c.t - w.e[-1] >= 0.5 AND w.d - c.t >= 0.5 THEN list_append(w.e, c.t) ELSE w.e END, w.d FROM edge_walk w JOIN cut c ON c.rec_id = w.rec_id AND c.k = w.k + 1),
edges AS (SELECT rec_id, list_append(arg_max(e, k), any_value(d)) AS e FROM edge_walk GROUP BY rec_id),
shots AS MATERIALIZED (SELECT rec_id, i - 1 AS shot, e[i] AS t0, e[i + 1] AS t1 FROM (SELECT rec_id, e, unnest(range(1, len(e))) AS i FROM edges))"""
KINDS = "STRUCT(kind VARCHAR, p1 DOUBLE, p2 DOUBLE, p3 DOUBLE, p4 DOUBLE, q1 DOUBLE, q2 DOUBLE, q3 DOUBLE, q4 DOUBLE)[]"
ONE_KIND = "{{'kind': {0}kind, 'p1': {0}p1, 'p2': {0}p2, 'p3': {0}p3, 'p4': {0}p4, 'q1': {0}q1, 'q2': {0}q2, 'q3': {0}q3, 'q4': {0}q4}}"
SIDES = "p1 p2 p3 p4 q1 q2 q3 q4".split()


@query(f"""WITH RECURSIVE {SHOTS}, f AS (SELECT rec_id, idx * CAST(0.2 AS DOUBLE) AS t, CAST(0.5 AS DOUBLE) + (idx % 3) * CAST(0.013 AS DOUBLE) AS c1, CAST(0.1 AS DOUBLE) + (rec_id % 3) * CAST(0.1 AS DOUBLE) AS w1, least(db / 300, 0.29) AS h2, least(db / 200, 0.28) AS h3, idx % 5 >= 2 AS sure FROM levels),
s AS (SELECT f.*, shot, sure AND h2 >= 0.45 * 0.3 AS f2, h3 >= 0.45 * 0.3 AS f3 FROM f JOIN shots USING (rec_id) WHERE t0 <= t AND t < t1),
two AS (SELECT *, f2 AND (NOT f3 OR h2 >= h3) AS low FROM s WHERE f2 OR f3),
mid AS (SELECT rec_id, shot, quantile_cont(CASE WHEN low THEN 0.2 ELSE c1 END, 0.5) AS p1, quantile_cont(CASE WHEN low THEN 0.1 ELSE w1 END, 0.5) AS p3, quantile_cont(CASE WHEN low THEN h2 ELSE 0.3 END, 0.5) AS p4, quantile_cont(CASE WHEN low THEN c1 ELSE 0.8 END, 0.5) AS q1, quantile_cont(CASE WHEN low THEN w1 ELSE 0.1 END, 0.5) AS q3, quantile_cont(CASE WHEN low THEN 0.3 ELSE h3 END, 0.5) AS q4 FROM two GROUP BY rec_id, shot),
v AS (SELECT rec_id, shot, count(*) AS n, count(*) FILTER (f2 AND f3) AS crowds, count(*) FILTER (f2 OR f3) AS pairs, quantile_cont(c1, 0.5) AS c, any_value(w1) AS w FROM s GROUP BY rec_id, shot),
told AS (SELECT h.rec_id, t0, t1, CASE WHEN n IS NULL OR crowds >= 0.5 * n THEN 'fit' WHEN pairs >= 0.35 * n THEN CASE WHEN (q1 + q3 * 0.9) - (p1 - p3 * 0.9) <= 0.56 THEN 'both' ELSE 'stack' END ELSE 'one' END AS way, p1, p3, p4, q1, q3, q4, c, w FROM shots h LEFT JOIN v ON v.rec_id = h.rec_id AND v.shot = h.shot LEFT JOIN mid ON mid.rec_id = h.rec_id AND mid.shot = h.shot),
segs AS MATERIALIZED (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY t0) AS k, t0, t1, CASE WHEN way IN ('both', 'one') THEN 'crop' ELSE way END AS kind, CASE way WHEN 'both' THEN (p1 + q1) / 2 WHEN 'one' THEN c WHEN 'stack' THEN p1 END AS p1, CASE WHEN way IN ('one', 'stack') THEN CAST(0.5 AS DOUBLE) END AS p2, CASE way WHEN 'one' THEN w WHEN 'stack' THEN p3 END AS p3, CASE way WHEN 'one' THEN CAST(0.3 AS DOUBLE) WHEN 'stack' THEN p4 END AS p4,
  CASE WHEN way = 'stack' THEN q1 END AS q1, CASE WHEN way = 'stack' THEN CAST(0.5 AS DOUBLE) END AS q2, CASE WHEN way = 'stack' THEN q3 END AS q3, CASE WHEN way = 'stack' THEN q4 END AS q4 FROM told),
steady AS (
  SELECT *, CASE WHEN kind = 'fit' THEN CAST([] AS {KINDS}) ELSE CAST([{ONE_KIND.format("")}] AS {KINDS}) END AS seen FROM segs WHERE k = 1
  UNION ALL
  SELECT rec_id, k, t0, t1, kind, {", ".join(f"CASE WHEN m IS NULL THEN {c} ELSE m.{c} END" for c in SIDES)}, CASE WHEN kind = 'fit' OR m IS NOT NULL THEN seen ELSE list_append(seen, {ONE_KIND.format("")}) END
  FROM (SELECT x.*, w.seen, list_filter(w.seen, lambda y: y.kind = x.kind AND abs(y.p1 - x.p1) < 0.04 AND (x.kind <> 'stack' OR abs(y.q1 - x.q1) < 0.04))[1] AS m FROM steady w JOIN segs x ON x.rec_id = w.rec_id AND x.k = w.k + 1)
), new AS (SELECT *, CASE WHEN {" AND ".join(f"{c} IS NOT DISTINCT FROM lag({c}) OVER o" for c in ["kind", *SIDES])} AND k > 1 THEN 0 ELSE 1 END AS new FROM steady WINDOW o AS (PARTITION BY rec_id ORDER BY k)),
run AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY k) AS g FROM new),
joined AS (SELECT rec_id, min(t0) AS a, max(t1) AS b, any_value(kind) AS kind, {", ".join(f"any_value({c}) AS {c}" for c in SIDES)} FROM run GROUP BY rec_id, g)
SELECT rec_id, round(a, 4) AS start, round(b, 4) AS "end", CASE WHEN kind = 'crop' AND p3 > 0.4 * 0.56 THEN 'fit' ELSE kind END AS kind, round(p1, 6) AS cx, round(p3, 6) AS w, round(q1, 6) AS cx2, round(q4, 6) AS h2 FROM joined""")
def shot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each shot of a recording is shown, framings that come again reused and equal neighbours joined."""
    x = levels(spark, sf_dir)
    face = lambda cx, w, h, s: F.struct(cx.alias("cx"), F.lit(0.5).alias("cy"), w.alias("w"), h.alias("h"), s.alias("score"))
    faces = F.array(
        face(0.5 + (F.col("idx") % 3) * 0.013, 0.1 + (F.col("rec_id") % 3) * 0.1, F.lit(0.3), F.lit(0.9)), face(F.lit(0.2), F.lit(0.1), F.least(F.col("db") / 300, F.lit(0.29)), 0.5 + (F.col("idx") % 5) / 8),
        face(F.lit(0.8), F.lit(0.1), F.least(F.col("db") / 200, F.lit(0.28)), F.lit(0.8)),
    )
    cuts = x.where(F.col("db") / 500 >= 0.1).select("rec_id", (F.col("idx") * 0.2).alias("t"))
    ends = x.groupBy("rec_id").agg((F.max("idx") * 0.2 + 1).alias("duration"))
    planned = V.planned(x.select("rec_id", (F.col("idx") * 0.2).alias("t"), faces.alias("faces")), cuts, ends, 0.56)
    return planned.select("rec_id", r4("start").alias("start"), r4("end").alias("end"), "kind", F.round("person.cx", 6).alias("cx"), F.round("person.w", 6).alias("w"), F.round("below.cx", 6).alias("cx2"), F.round("below.h", 6).alias("h2"))


CROP = f"""c1 AS (SELECT *, least(CAST(width AS DOUBLE), height * 1080 / 1920) AS f FROM p), c2 AS (SELECT *, {EVEN.format("CASE WHEN face > 0 AND 5.0 * face * width < 0.85 * f THEN greatest(5.0 * face * width, f / 2, least(f, 400.0)) ELSE f END")} AS w FROM c1),
c3 AS (SELECT *, {EVEN.format("least(CAST(height AS DOUBLE), CAST(w AS DOUBLE) * 1920 / 1080)")} AS h FROM c2),
crop AS (SELECT id, width, height, cy, face, w, h, CAST(round_even(least(greatest(cx * width - w / 2, 0.0), width - w), 0) AS INTEGER) AS x, CAST(round_even(CASE WHEN h < height AND cy > 0 THEN least(greatest(cy * height - 0.38 * h, 0.0), height - h) ELSE (height - h) / 2 END, 0) AS INTEGER) AS y FROM c3),
f1 AS (SELECT *, {EVEN.format("least(CAST(width AS DOUBLE), greatest(face * width / 0.28, least(CAST(width AS DOUBLE), height * 1080 / 1920)))")} AS w0 FROM p), f2 AS (SELECT *, {EVEN.format("least(CAST(height AS DOUBLE), w0 * 1.25)")} AS h0 FROM f1),
fit AS (SELECT *, {EVEN.format("1080 * h / w")} AS inner_h FROM (SELECT id, face > 0 AS part, CASE WHEN face > 0 THEN w0 ELSE width END AS w, CASE WHEN face > 0 THEN h0 ELSE height END AS h, CASE WHEN face > 0 THEN CAST(round_even(least(greatest(cx * width - w0 / 2, 0.0), width - w0), 0) AS INTEGER) ELSE 0 END AS x,
  CASE WHEN face > 0 THEN CAST(round_even(least(greatest(cy * height - 0.42 * h0, 0.0), height - h0), 0) AS INTEGER) ELSE 0 END AS y FROM f2))"""
BLUR = "scale=270:480:force_original_aspect_ratio=increase,crop=270:480,boxblur=10:2,scale=1080:1920:flags=bilinear,eq=brightness=-0.12:saturation=0.9"


@query(f"""WITH {TWO}, {CROP} SELECT c.id, CASE c.id % 4 WHEN 0 THEN printf('crop=%d:%d:%d:%d,scale=1080:1920:flags=bicubic,setsar=1', c.w, c.h, c.x, c.y)
WHEN 1 THEN printf('split=2[xa][xb];[xa]crop=%d:%d:%d:%d,scale=1080:960:flags=bicubic[xt];[xb]crop=%d:%d:%d:%d,scale=1080:960:flags=bicubic[xu];[xt][xu]vstack=inputs=2,setsar=1', k.w, k.h, k.x1, k.y1, k.w, k.h, k.x2, k.y2)
WHEN 2 THEN printf('split=2[xa][xb];[xa]crop=%d:%d:%d:%d,scale=1080:656:flags=bicubic[xt];[xb]crop=%d:%d:%d:%d,scale=1080:1264:flags=bicubic[xu];[xt][xu]vstack=inputs=2,setsar=1', s.w, s.h, s.x, s.y, s.gw, s.gh, s.gx, s.gy)
ELSE CASE WHEN f.w = c.width AND f.h = c.height THEN '' ELSE printf('crop=%d:%d:%d:%d,', f.w, f.h, f.x, f.y) END || printf('split=2[xa][xb];[xa]{BLUR}[xg];[xb]scale=1080:%d:flags=bicubic[xf];[xg][xf]overlay=(W-w)/2:(H-h)/2,setsar=1', f.inner_h) END AS graph,
round(CASE WHEN c.id % 4 = 1 THEN greatest(0.0, ((c.cy - 0.85 * (c.face * 1.2)) * c.height - k.y1) * 960 / k.h) WHEN c.id % 4 = 0 AND c.face > 0 THEN greatest(0.0, ((c.cy - 0.85 * (c.face * 1.2)) * c.height - c.y) * 1920 / c.h) END, 4) AS head
FROM crop c JOIN stack k ON k.id = c.id JOIN split s ON s.id = c.id JOIN fit f ON f.id = c.id""")
def layout_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter graph of a layout for pictures of many sizes, and where the head of the person begins."""
    cx, cy, face, width, height = (F.col(c) for c in ("cx", "cy", "face", "width", "height"))
    at = lambda x: F.struct(x.alias("cx"), cy.alias("cy"), face.alias("w"))
    p = _pictures(spark, sf_dir).withColumn("kind", F.when(F.col("id") % 4 == 0, "crop").when(F.col("id") % 4 == 1, "stack").when(F.col("id") % 4 == 2, "split").otherwise("fit"))
    p = p.select("*", G.crop_box(cx, cy, face, width, height).alias("c"), G.stack_boxes(at(cx), at(1 - cx), width, height).alias("k"), G.split_boxes(cx, cy, face, width, height).alias("s"), G.fit_box(cx, cy, face, width, height).alias("f"))
    kind = F.col("kind")
    box = lambda c: G.box(*[F.col(f"{c}.{n}").cast("int") for n in "whxy"])
    first = F.when(kind == "crop", box("c")).when(kind == "stack", box("k.top")).when(kind == "split", box("s.cam")).otherwise(box("f"))
    second = F.when(kind == "stack", box("k.bottom")).otherwise(box("s.game"))
    whole = (F.col("f.w") == width) & (F.col("f.h") == height)
    person = F.struct(cx.alias("cx"), cy.alias("cy"), face.alias("w"), (face * 1.2).alias("h"))
    graph = G.layout_graph(kind, first, second, G.even(1080 * F.col("f.h") / F.col("f.w")), whole, F.lit("x"))
    return p.select("id", graph.alias("graph"), r4(G.head_top(kind, person, first, height)).alias("head"))


@query(f"""WITH {LEVELS}, k AS (SELECT rec_id, CASE (idx // 4 + rec_id) % 4 WHEN 0 THEN 'crop' WHEN 1 THEN 'fit' WHEN 2 THEN CASE WHEN rec_id % 3 = 0 THEN 'stack' ELSE 'fit' END ELSE 'split' END AS kind, min(idx) * 30 AS a, max(idx) * 30 + 30 + (idx // 4) % 7 AS b FROM levels WHERE idx < 4 * (3 + rec_id % 5) GROUP BY rec_id, idx // 4),
w AS (SELECT rec_id, kind, sum(b - a) AS n, min(a) AS seen FROM k GROUP BY rec_id, kind), m AS (SELECT rec_id, arg_max(kind, n * 1000000 - seen) AS most, bool_or(kind = 'stack') AS stacked FROM w GROUP BY rec_id),
o AS (SELECT rec_id, arg_min(kind, a) AS kind, min(a) AS a FROM k GROUP BY rec_id), g AS (SELECT rec_id, arg_max(a, (b - a) * 1000000 - a) AS a FROM k WHERE kind = 'fit' GROUP BY rec_id),
x AS (SELECT m.*, o.kind AS opens, CASE WHEN o.kind IN ('crop', 'stack') THEN 100.0 + m.rec_id % 9 - 24 END AS head, 300.0 + g.a % 400 AS top, 1500.0 - g.a % 400 AS bottom FROM m JOIN o USING (rec_id) LEFT JOIN g USING (rec_id))
SELECT rec_id, CAST(CASE WHEN most = 'split' THEN 796 WHEN stacked THEN 960 WHEN most = 'fit' THEN trunc(least(greatest(bottom + 150, 1920 * 0.66), 1920 * 0.775)) ELSE 1267 END AS INTEGER) AS caption_y,
CAST(CASE WHEN most = 'split' THEN 596 WHEN stacked THEN 200 WHEN most = 'fit' THEN trunc(greatest(least(top - 150, 1920 * 0.17), 1920 * 0.115)) ELSE 316 END AS INTEGER) AS title_y,
CAST(CASE WHEN most = 'split' THEN NULL WHEN stacked THEN head WHEN most = 'fit' AND opens = 'fit' THEN 276.0 ELSE head END AS DOUBLE) AS floor FROM x""")
def text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where captions and headlines go over pieces of several layouts."""
    x = levels(spark, sf_dir).where(F.col("idx") < 4 * (3 + F.col("rec_id") % 5)).withColumn("s", F.floor(F.col("idx") / 4))
    turn = (F.col("s") + F.col("rec_id")) % 4
    kind = F.when(turn == 0, "crop").when(turn == 1, "fit").when(turn == 2, F.when(F.col("rec_id") % 3 == 0, "stack").otherwise("fit")).otherwise("split")
    pieces = x.withColumn("kind", kind).groupBy("rec_id", "s", "kind").agg((F.min("idx") * 30).alias("first"), (F.max("idx") * 30 + 30).alias("_b")).withColumn("last", F.col("_b") + F.col("s") % 7)
    band = F.struct((300.0 + F.col("first") % 400).alias("top"), (1500.0 - F.col("first") % 400).alias("bottom"))
    pieces = pieces.withColumn("head", F.when(F.col("kind").isin("crop", "stack"), 100.0 + F.col("rec_id") % 9)).withColumn("band", F.when(F.col("kind") == "fit", band))
    return V.text_places(pieces.select("rec_id", "first", "last", "kind", "head", "band"))
