"""Levels, loud moments, pauses, joins in time, cuts and layouts, over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import geometry as G
from tempora.functions import text as T
from tempora.operators import framing as V
from tempora.operators import signal as L
from tempora.operators import temporal as M
from tempora.plans.adapters import LEVELS, MOMENTS, TURN_LINES, TURN_WORDS, levels, moments, r4, registry, table, turn_lines, turn_words

QUERIES, ORACLE_SQL, query = registry()

ISLANDS = f"""{LEVELS}, lim AS (SELECT rec_id, quantile_cont(db, 0.95) AS loud, quantile_cont(db, 0.10) AS quiet FROM levels GROUP BY rec_id HAVING quantile_cont(db, 0.95) - quantile_cont(db, 0.10) >= 18),
q AS (SELECT l.rec_id, l.idx, l.idx - row_number() OVER (PARTITION BY l.rec_id ORDER BY l.idx) AS g FROM levels l JOIN lim USING (rec_id) WHERE db < greatest(loud - 30, quiet + 6)),
silent AS MATERIALIZED (SELECT rec_id, min(idx) AS first, max(idx) AS last FROM q GROUP BY rec_id, g HAVING max(idx) - min(idx) + 1 >= 1)"""


def _silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet runs of each user's values, one frame a second."""
    return L.silences(levels(spark, sf_dir), frame=1.0, min_len=1.0)


@query(f"""WITH {ISLANDS} SELECT rec_id, first, last, CAST(first AS DOUBLE) AS start, CAST(last + 1 AS DOUBLE) AS "end" FROM silent""")
def silence_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet runs against exact percentiles of each recording."""
    return _silences(spark, sf_dir).select("rec_id", "first", "last", "start", "end")


@query(f"""WITH {LEVELS} SELECT rec_id, CAST(idx // 10 AS BIGINT) AS sec, round(quantile_cont(db, 0.9), 4) AS db FROM levels GROUP BY rec_id, idx // 10 HAVING count(*) = 10""")
def loudness_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How loud each ten frames get; partial ones are dropped."""
    return L.loudness(levels(spark, sf_dir), per=10).select("rec_id", "sec", r4("db").alias("db"))


PADS = f"""{LEVELS}, ends AS (SELECT rec_id, arg_min(db, idx) AS a, arg_max(db, idx) AS b, min(idx) AS lo, max(idx) AS hi FROM levels GROUP BY rec_id),
padded AS (SELECT rec_id, idx, db, true AS own FROM levels UNION ALL SELECT rec_id, lo - k, a, false FROM ends, range(1, 6) r(k) UNION ALL SELECT rec_id, hi + k, b, false FROM ends, range(1, 6) r(k)),
rolled AS MATERIALIZED (SELECT rec_id, idx, db, around FROM (SELECT *, quantile_cont(db, 0.5) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS around FROM padded) WHERE own)"""


@query(f"""WITH {PADS} SELECT rec_id, idx, round(around, 4) AS around, db >= around + 7 AS stands_out FROM rolled""")
def rolling_median_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of eleven values around each, and which values stand out."""
    x = L.rolling_median(levels(spark, sf_dir), 5, order="idx")
    return x.select("rec_id", "idx", r4("around").alias("around"), (F.col("db") >= F.col("around") + 7).alias("stands_out"))


LOUD = f"""{LEVELS}, series AS (SELECT rec_id, list(db ORDER BY idx) AS v, count(*) AS n, least(150, count(*) // 2) AS h FROM levels GROUP BY rec_id),
rolled AS MATERIALIZED (SELECT l.rec_id, l.idx, l.db, list_median(list_transform(range(l.idx - h, l.idx + h + 1), lambda k: v[greatest(1, least(n, k + 1))])) AS around FROM levels l JOIN series USING (rec_id)), facts AS (SELECT rec_id, quantile_cont(db, 0.85) AS typical FROM levels GROUP BY rec_id HAVING count(*) >= 30 AND quantile_cont(db, 0.85) - quantile_cont(db, 0.15) >= 6),
hit AS (SELECT r.rec_id, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY r.rec_id ORDER BY idx) <= 3 THEN 0 ELSE 1 END AS new FROM rolled r JOIN facts USING (rec_id) WHERE db >= greatest(around + 7, typical + 3.5)),
run AS (SELECT rec_id, idx, sum(new) OVER (PARTITION BY rec_id ORDER BY idx) AS g FROM hit),
ev AS (SELECT rec_id, min(idx) AS a, max(idx) AS b FROM run GROUP BY rec_id, g),
lifted AS (SELECT e.rec_id, a, b, max(l.db) - any_value(typical) AS lift FROM ev e JOIN facts USING (rec_id) JOIN levels l ON l.rec_id = e.rec_id AND l.idx BETWEEN a AND b GROUP BY e.rec_id, a, b),
loud_ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY lift + least(6, b - a + 1) DESC, a DESC, b DESC) AS r FROM lifted WHERE b - a + 1 >= 2 OR lift >= 8),
loud_chosen AS (
  SELECT rec_id, r, [a] AS kept, true AS taken FROM loud_ranked WHERE r = 1
  UNION ALL
  SELECT rec_id, r, CASE WHEN free THEN list_append(kept, a) ELSE kept END, free FROM (
    SELECT x.rec_id, x.r, x.a, c.kept, len(c.kept) < 12 AND len(list_filter(c.kept, lambda k: abs(k - x.a) < 20)) = 0 AS free FROM loud_chosen c JOIN loud_ranked x ON x.rec_id = c.rec_id AND x.r = c.r + 1)
), loud AS MATERIALIZED (SELECT x.rec_id, CAST(x.a AS DOUBLE) AS "at", CAST(x.b + 1 AS DOUBLE) AS "end", round(x.lift, 1) AS lift FROM loud_ranked x JOIN loud_chosen c ON c.rec_id = x.rec_id AND c.r = x.r AND c.taken)"""


def loud_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = levels(spark, sf_dir).select("rec_id", F.col("idx").alias("sec"), "db")
    return L.loud_moments(series, least=30)


@query(f"""WITH RECURSIVE {LOUD} SELECT rec_id, "at", "end", lift FROM loud""")
def loud_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches much louder than the talk around them, twelve a recording at most, twenty seconds apart."""
    return loud_of(spark, sf_dir)


@query(f"""WITH RECURSIVE {LOUD}, {TURN_LINES} SELECT DISTINCT t.rec_id, t.idx FROM turn_lines t JOIN loud l ON l.rec_id = t.rec_id AND t.start <= l."end" + 1 AND t."end" >= l."at" - 1""")
def loud_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversation n during which user n's series is loud."""
    return M.loud_lines(turn_lines(spark, sf_dir), loud_of(spark, sf_dir)).select("rec_id", "idx")


@query(f"""WITH {MOMENTS}, w AS (SELECT rec_id, id, t FROM moments WHERE kind <> 'error'), p AS (SELECT rec_id, t AS a, value AS length FROM moments WHERE kind = 'error'),
last AS (SELECT rec_id, max(t) AS t FROM w GROUP BY rec_id), hit AS (SELECT p.rec_id, w.id, w.t, p.length FROM p ASOF JOIN w ON w.rec_id = p.rec_id AND w.t < p.a + 0.1)
SELECT h.rec_id, h.id, round(max(h.length), 4) AS length FROM hit h JOIN last l ON l.rec_id = h.rec_id AND h.t < l.t GROUP BY h.rec_id, h.id""")
def pause_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest error after each other event of its user: an as-of join backwards."""
    e = moments(spark, sf_dir)
    order = F.row_number().over(Window.partitionBy("rec_id").orderBy("t", "id")).cast("int")
    words = e.where("kind <> 'error'").select("rec_id", "id", order.alias("word_idx"), F.col("t").alias("start"))
    pauses = e.where("kind = 'error'").select("rec_id", F.col("t").alias("start"), (F.col("t") + F.col("value")).alias("end"))
    found = M.last_word_before(words.select("rec_id", "word_idx", "start"), pauses)
    return found.join(words, ["rec_id", "word_idx"]).select("rec_id", "id", r4("length").alias("length"))


@query(f"""WITH {MOMENTS}, l AS (SELECT rec_id, id, t AS a, t + value * 60 AS b FROM moments WHERE kind = 'view'), p AS (SELECT rec_id, id AS pid, t, CAST(value AS BIGINT) AS views FROM moments WHERE kind = 'purchase'),
near AS (SELECT p.rec_id, p.pid, p.views, l.id, CASE WHEN t BETWEEN a AND b THEN 0.0 ELSE least(abs(a - t), abs(b - t)) END AS far FROM p JOIN l USING (rec_id)),
best AS (SELECT * FROM near WHERE far <= 3600 QUALIFY row_number() OVER (PARTITION BY rec_id, pid ORDER BY far, id) = 1)
SELECT rec_id, id AS idx, CAST(sum(views) AS BIGINT) AS views FROM best GROUP BY rec_id, id""")
def hint_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases go to the nearest view of their user, an hour away at most."""
    lines = moments(spark, sf_dir, "view").select("rec_id", F.col("id").alias("idx"), F.col("t").alias("start"), (F.col("t") + F.col("value") * 60).alias("end"))
    points = moments(spark, sf_dir, "purchase").select("rec_id", F.col("id").alias("point_id"), F.col("t").alias("at"), F.bround("value", 0).cast("long").alias("views"))
    return M.nearest_line(lines, points, 3600.0)


@query(f"""WITH {MOMENTS}, b AS (SELECT rec_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) <= 21600 THEN 0 ELSE 1 END AS new FROM moments),
g AS (SELECT rec_id, t, sum(new) OVER (PARTITION BY rec_id ORDER BY t) AS g FROM b) SELECT rec_id, min(t) AS first, max(t) AS last, count(*) AS n FROM g GROUP BY rec_id, g""")
def session_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that follow each other within six hours."""
    return M.merge_gaps(moments(spark, sf_dir).select("rec_id", "t"), 21600.0)


@query("""WITH o AS (SELECT o_custkey AS rec_id, o_orderkey AS a_id, epoch(o_orderdate) / 86400 AS d FROM orders), x AS (SELECT rec_id, a_id, d, d + 30 AS e FROM o)
SELECT a.rec_id, a.a_id, b.a_id AS b_id, CAST(round(least(a.e, b.e) - greatest(a.d, b.d)) AS BIGINT) AS shared FROM x a JOIN x b ON a.rec_id = b.rec_id AND a.a_id < b.a_id AND a.d < b.e AND b.d < a.e""")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer whose thirty days overlap, and by how many days."""
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400e6
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec_id"), F.col("o_orderkey").alias("a_id"), day.alias("a"), (day + 30).alias("e"))
    other = o.select("rec_id", F.col("a_id").alias("b_id"), F.col("a").alias("b"), F.col("e").alias("f"))
    pairs = M.overlap_join(o, other, 30.0, "a", "e", "b", "f", strict=True).where("a_id < b_id")
    return pairs.select("rec_id", "a_id", "b_id", F.round(F.least("e", "f") - F.greatest("a", "b")).cast("long").alias("shared"))


SCORES = f"""{LEVELS}, s AS (SELECT rec_id, idx AS frame, db / 500 AS score FROM levels)"""


@query(f"""WITH {SCORES}, n AS (SELECT *, greatest(max(score) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), max(score) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS near,
  list_concat(coalesce(list(score) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), []), coalesce(list(score) OVER (PARTITION BY rec_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING), [])) AS around FROM s)
SELECT rec_id, frame, round(score, 6) AS score FROM n WHERE score >= 0.06 AND NOT coalesce(score < near, false) AND (score >= 0.30 OR score >= 5 * coalesce(list_median(around), 0.0) + 0.03)""")
def scene_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-frame spikes of a score."""
    s = levels(spark, sf_dir).select("rec_id", F.col("idx").alias("frame"), (F.col("db") / 500).alias("score"))
    return L.scene_cuts(s).select("rec_id", "frame", F.round("score", 6).alias("score"))


CLIPS = """clips AS (SELECT rec_id, CAST(max(idx) AS DOUBLE) + 1 AS total FROM levels GROUP BY rec_id), words AS (SELECT rec_id, idx + 0.1 AS start, idx + 0.4 AS "end" FROM levels WHERE db > 60)"""
CUTS = f"""{ISLANDS}, {CLIPS}, cuts AS MATERIALIZED (SELECT s.rec_id, CAST(s.first AS DOUBLE) + 0.18 AS a, CAST(s.last + 1 AS DOUBLE) - 0.12 AS b FROM silent s JOIN clips c USING (rec_id) WHERE s.last + 1 - s.first > 2.5 AND s.first > 0 AND s.last + 1 < c.total
  AND NOT EXISTS (SELECT 1 FROM words w WHERE w.rec_id = s.rec_id AND w.start >= s.first + 0.18 AND w."end" <= s.last + 1 - 0.12))"""


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cuts, kept pieces) of one clip per user, from its quiet runs."""
    x = levels(spark, sf_dir)
    clips = x.groupBy("rec_id").agg((F.max("idx") + 1.0).alias("end")).select("rec_id", F.lit(0).alias("clip"), F.lit(0.0).alias("start"), "end")
    words = x.where("db > 60").select("rec_id", (F.col("idx") + 0.1).alias("start"), (F.col("idx") + 0.4).alias("end"))
    cuts = M.removed_middles(clips, _silences(spark, sf_dir), words, max_pause=2.5)
    return cuts, M.kept_pieces(clips, cuts)


@query(f"""WITH {CUTS} SELECT rec_id, round(a, 4) AS cut_start, round(b, 4) AS cut_end FROM cuts""")
def tighten_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middles of long quiet runs that hold no whole word."""
    return _pieces(spark, sf_dir)[0].select("rec_id", r4("cut_start").alias("cut_start"), r4("cut_end").alias("cut_end"))


PIECES = f"""{CUTS}, edges AS (SELECT rec_id, CAST(0 AS DOUBLE) AS "at", NULL AS stop FROM clips UNION ALL SELECT rec_id, b, a FROM cuts),
pieces AS MATERIALIZED (SELECT rec_id, row_number() OVER w - 1 AS piece, "at" AS start, coalesce(lead(stop) OVER w, total) AS "end" FROM edges JOIN clips USING (rec_id) WINDOW w AS (PARTITION BY rec_id ORDER BY "at"))"""


@query(f"""WITH {PIECES} SELECT rec_id, CAST(piece AS INTEGER) AS piece, round(start, 4) AS start, round("end", 4) AS "end",
round(coalesce(sum("end" - start) OVER (PARTITION BY rec_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS clip_start FROM pieces""")
def tighten_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cuts leave, on the clip's clock."""
    return _pieces(spark, sf_dir)[1].select("rec_id", "piece", r4("start").alias("start"), r4("end").alias("end"), r4("clip_start").alias("clip_start"))


@query(f"""WITH {PIECES}, t AS (SELECT *, row_number() OVER () AS id FROM (SELECT rec_id, idx FROM levels UNION ALL SELECT rec_id, idx FROM levels WHERE idx % 5 = 0))
SELECT t.rec_id, t.idx, round(sum(greatest(0.0, least(t.idx + 0.1, p."end") - p.start)), 4) AS clip_t FROM t JOIN pieces p USING (rec_id) GROUP BY t.id, t.rec_id, t.idx""")
def retimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's moment on the clock of the tightened clip; each fifth comes twice."""
    frames = levels(spark, sf_dir)
    t = frames.unionByName(frames.where("idx % 5 = 0"))
    t = t.select("rec_id", F.lit(0).alias("clip"), "idx", (F.col("idx") + 0.1).alias("t"))
    return M.retime(t, _pieces(spark, sf_dir)[1]).select("rec_id", "idx", r4("clip_t").alias("clip_t"))


@query(f"""WITH {LEVELS}, kinds AS (SELECT rec_id, idx // 4 AS s, CASE (idx // 4) % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'pair' ELSE 'fit' END AS kind, min(idx) AS a, max(idx) + 1 AS b FROM levels GROUP BY ALL),
per AS (SELECT rec_id, kind, sum((b - a) * 30) AS frames, min(a) AS seen FROM kinds GROUP BY rec_id, kind)
SELECT rec_id, arg_max(kind, frames * 1000000 - seen) AS kind, CAST(max(frames) AS BIGINT) AS frames, string_agg(kind, '+' ORDER BY kind) AS kinds FROM per GROUP BY rec_id""")
def dominant_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout with the most frames of each recording, after cutting segments of four seconds at the recording's ends."""
    x = levels(spark, sf_dir)
    s = F.floor(F.col("idx") / 4)
    kind = F.when(s % 3 == 0, "one").when(s % 3 == 1, "pair").otherwise("fit")
    segments = x.withColumn("s", s).withColumn("kind", kind).groupBy("rec_id", "s", "kind").agg(F.min("idx").cast("double").alias("start"), (F.max("idx") + 1.0).alias("end"))
    kept = x.groupBy("rec_id").agg(F.lit(0).alias("clip"), F.lit(0).cast("long").alias("first"), ((F.max("idx") + 1) * 30).cast("long").alias("last"))
    return V.dominant_layout(M.cut_segments(kept, segments.select("rec_id", F.lit(0).alias("clip"), "start", "end", "kind", F.lit(None).cast("double").alias("framing"))))


@query(f"""WITH {LEVELS}, f AS (SELECT rec_id, idx // 10 AS shot, [{{'h': 0.30, 's': 0.9}}, {{'h': db / 300, 's': 0.5 + (idx % 5) / 8}}, {{'h': db / 200, 's': 0.8}}] AS faces FROM levels),
g AS (SELECT rec_id, shot, list_filter(faces, lambda x: x.s >= 0.7 AND x.h >= 0.03) AS good FROM f),
m AS (SELECT rec_id, shot, good, list_max(list_transform(good, lambda x: x.h)) AS big FROM g),
n AS (SELECT rec_id, shot, CASE WHEN big >= 0.07 THEN len(list_filter(good, lambda x: x.h >= 0.45 * big)) ELSE 0 END AS n FROM m)
SELECT rec_id, CAST(shot AS BIGINT) AS shot, count(*) AS total, count(*) FILTER (n >= 3) AS crowds, count(*) FILTER (n >= 2) AS pairs, count(*) FILTER (n >= 1) AS singles,
CASE WHEN count(*) FILTER (n >= 3) >= 0.5 * count(*) THEN 'fit' WHEN count(*) FILTER (n >= 2) >= 0.35 * count(*) THEN 'pair' WHEN count(*) FILTER (n >= 1) >= 0.4 * count(*) THEN 'one' ELSE 'fit' END AS layout FROM n GROUP BY rec_id, shot""")
def layout_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of up to three faces, voted on by shots of ten frames."""
    face = lambda cx, h, s: F.struct(cx.alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.1).alias("w"), h.alias("h"), s.alias("score"))
    faces = F.array(face(F.lit(0.5), F.lit(0.30), F.lit(0.9)), face(F.lit(0.2), F.col("db") / 300, 0.5 + (F.col("idx") % 5) / 8), face(F.lit(0.8), F.col("db") / 200, F.lit(0.8)))
    return V.layout_votes(levels(spark, sf_dir).select("rec_id", F.floor(F.col("idx") / 10).alias("shot"), F.col("idx").alias("t"), faces.alias("faces")))


@query(f"""WITH RECURSIVE {SCORES}, cut AS (SELECT rec_id, frame * 0.2 AS t, row_number() OVER (PARTITION BY rec_id ORDER BY frame) AS k FROM s WHERE score >= 0.1), dur AS (SELECT rec_id, max(frame) * 0.2 + 1 AS d FROM s GROUP BY rec_id),
walk AS (SELECT rec_id, CAST(0 AS BIGINT) AS k, CAST([0.0] AS DOUBLE[]) AS e, d FROM dur UNION ALL
  SELECT w.rec_id, c.k, CASE WHEN c.t - w.e[-1] >= 0.5 AND w.d - c.t >= 0.5 THEN list_append(w.e, c.t) ELSE w.e END, w.d FROM walk w JOIN cut c ON c.rec_id = w.rec_id AND c.k = w.k + 1),
done AS (SELECT rec_id, list_append(arg_max(e, k), any_value(d)) AS e FROM walk GROUP BY rec_id)
SELECT rec_id, CAST(i - 1 AS INTEGER) AS shot, round(e[i], 4) AS start, round(e[i + 1], 4) AS "end" FROM (SELECT rec_id, e, unnest(range(1, len(e))) AS i FROM done)""")
def shot_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots between cuts that are half a second apart at least."""
    x = levels(spark, sf_dir)
    cuts = x.where(F.col("db") / 500 >= 0.1).select("rec_id", (F.col("idx") * 0.2).alias("t"))
    ends = x.groupBy("rec_id").agg((F.max("idx") * 0.2 + 1).alias("duration"))
    return V.shot_bounds(cuts, ends).select("rec_id", "shot", r4("start").alias("start"), r4("end").alias("end"))


EVEN = "greatest(2, CAST(round_even(({}) / 2, 0) AS INTEGER) * 2)"


@query(f"""WITH p AS (SELECT p_partkey AS id, 640 + p_size * 32 AS width, 480 + (p_partkey % 7) * 60 AS height, (p_partkey % 100) / 100.0 AS cx, (p_partkey % 90) / 90.0 AS cy, (p_partkey % 13) / 100.0 AS face FROM part),
a AS (SELECT *, least(CAST(width AS DOUBLE), height * 1080 / 1920) AS f FROM p),
b AS (SELECT *, {EVEN.format("CASE WHEN face > 0 AND 5.0 * face * width < 0.85 * f THEN greatest(5.0 * face * width, f / 2, least(f, 400.0)) ELSE f END")} AS w FROM a),
c AS (SELECT *, {EVEN.format("least(CAST(height AS DOUBLE), CAST(w AS DOUBLE) * 1920 / 1080)")} AS h FROM b)
SELECT id, w, h, CAST(round_even(least(greatest(cx * width - w / 2, 0.0), width - w), 0) AS INTEGER) AS x,
CAST(round_even(CASE WHEN h < height AND cy > 0 THEN least(greatest(cy * height - 0.38 * h, 0.0), height - h) ELSE (height - h) / 2 END, 0) AS INTEGER) AS y FROM c""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window on the person for pictures of many sizes."""
    p = _pictures(spark, sf_dir)
    b = G.crop_box(F.col("cx"), F.col("cy"), F.col("face"), F.col("width"), F.col("height"))
    return p.select("id", b.alias("b")).select("id", "b.w", "b.h", "b.x", "b.y")


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (640 + F.col("p_size") * 32).cast("int").alias("width"), (480 + (k % 7) * 60).cast("int").alias("height"), ((k % 100) / 100.0).alias("cx"), ((k % 90) / 90.0).alias("cy"), ((k % 13) / 100.0).alias("face"))


@query(f"""WITH p AS (SELECT p_partkey AS id, 640 + p_size * 32 AS width, 480 + (p_partkey % 7) * 60 AS height, (p_partkey % 100) / 100.0 AS cx, (p_partkey % 90) / 90.0 AS cy, (p_partkey % 13) / 100.0 AS face FROM part),
a AS (SELECT *, {EVEN.format("least(CAST(width AS DOUBLE), greatest(face * width / 0.28, least(CAST(width AS DOUBLE), height * 1080 / 1920)))")} AS w0 FROM p),
b AS (SELECT *, {EVEN.format("least(CAST(height AS DOUBLE), w0 * 1.25)")} AS h0 FROM a)
SELECT id, CASE WHEN face > 0 THEN w0 ELSE width END AS w, CASE WHEN face > 0 THEN h0 ELSE height END AS h,
CASE WHEN face > 0 THEN CAST(round_even(least(greatest(cx * width - w0 / 2, 0.0), width - w0), 0) AS INTEGER) ELSE 0 END AS x,
CASE WHEN face > 0 THEN CAST(round_even(least(greatest(cy * height - 0.42 * h0, 0.0), height - h0), 0) AS INTEGER) ELSE 0 END AS y FROM b""")
def fit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole frame, or a window around one person, for pictures of many sizes."""
    b = G.fit_box(F.col("cx"), F.col("cy"), F.col("face"), F.col("width"), F.col("height"))
    return _pictures(spark, sf_dir).select("id", b.alias("b")).select("id", F.col("b.w").cast("int").alias("w"), F.col("b.h").cast("int").alias("h"), "b.x", "b.y")


PICTURES = "p AS (SELECT p_partkey AS id, 640 + p_size * 32 AS width, 480 + (p_partkey % 7) * 60 AS height, (p_partkey % 100) / 100.0 AS cx, (p_partkey % 90) / 90.0 AS cy, (p_partkey % 13) / 100.0 AS face FROM part)"
TWO = f"""{PICTURES}, s1 AS (SELECT *, {EVEN.format("least(greatest(face * width / 0.2, 160.0), CAST(width AS DOUBLE), height * (1080.0 / 656))")} AS w, {EVEN.format("least(CAST(width AS DOUBLE), height * 1080 / 1264.0)")} AS gw FROM p),
s2 AS (SELECT *, {EVEN.format("least(CAST(height AS DOUBLE), w / (1080.0 / 656))")} AS h, {EVEN.format("least(CAST(height AS DOUBLE), gw * 1264 / 1080.0)")} AS gh FROM s1),
s3 AS (SELECT *, least(greatest(cx * width - w / 2, 0.0), CAST(width - w AS DOUBLE)) AS x, least(greatest(cy * height - 0.44 * h, 0.0), CAST(height - h AS DOUBLE)) AS y, (width - gw) / 2 AS gx, 0.06 * width AS room FROM s2),
split AS (SELECT id, w, h, CAST(round_even(x, 0) AS INTEGER) AS x, CAST(round_even(y, 0) AS INTEGER) AS y, gw, gh, CAST(round_even(CASE WHEN x + w / 2 < width / 2 THEN gx + least(greatest((x + w) - gx, 0.0), room, width - gw - gx) ELSE gx - least(greatest((gx + gw) - x, 0.0), room, gx) END, 0) AS INTEGER) AS gx,
  CAST(round_even((height - gh) / 2, 0) AS INTEGER) AS gy FROM s3),
t1 AS (SELECT *, least(cx, 1 - cx) AS l, greatest(cx, 1 - cx) AS r, face * width AS f FROM p), t2 AS (SELECT *, least(abs(r - l) * width * 1.15, CAST(width AS DOUBLE), height * (1080 / 960.0)) AS widest, 2 * least(l, 1 - r) * width AS centred FROM t1),
t3 AS (SELECT *, {EVEN.format("greatest(least(4.0 * f, centred, widest), least(3.0 * f, widest), least(widest, 400.0))")} AS w FROM t2), t4 AS (SELECT *, {EVEN.format("least(CAST(height AS DOUBLE), w / (1080 / 960.0))")} AS h FROM t3),
stack AS (SELECT id, w, h, CAST(round_even(least(greatest(cx * width - w / 2, 0.0), CAST(width - w AS DOUBLE)), 0) AS INTEGER) AS x1, CAST(round_even(least(greatest(cy * height - 0.62 * h, 0.0), CAST(height - h AS DOUBLE)), 0) AS INTEGER) AS y1,
  CAST(round_even(least(greatest((1 - cx) * width - w / 2, 0.0), CAST(width - w AS DOUBLE)), 0) AS INTEGER) AS x2, CAST(round_even(least(greatest(cy * height - 0.42 * h, 0.0), CAST(height - h AS DOUBLE)), 0) AS INTEGER) AS y2 FROM t4)"""
BOX = """printf('{{"w":%d,"h":%d,"x":%d,"y":%d}}', {})"""


@query(f"""WITH {TWO} SELECT id, {BOX.format("a.w, a.h, a.x, a.y")} AS cam, {BOX.format("a.gw, a.gh, a.gx, a.gy")} AS game, {BOX.format("b.w, b.h, b.x1, b.y1")} AS top, {BOX.format("b.w, b.h, b.x2, b.y2")} AS bottom FROM split a JOIN stack b USING (id)""")
def split_stack_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows for a camera over a game, and for two people one above the other, for pictures of many sizes."""
    at = lambda cx: F.struct(cx.alias("cx"), F.col("cy").alias("cy"), F.col("face").alias("w"))
    cam = G.split_boxes(F.col("cx"), F.col("cy"), F.col("face"), F.col("width"), F.col("height"))
    two = G.stack_boxes(at(F.col("cx")), at(1 - F.col("cx")), F.col("width"), F.col("height"))
    return _pictures(spark, sf_dir).select("id", cam.alias("s"), two.alias("t")).select("id", *[F.to_json(f"{a}.{b}").alias(b) for a, b in (("s", "cam"), ("s", "game"), ("t", "top"), ("t", "bottom"))])


@query(f"""WITH {MOMENTS}, s AS (SELECT id, greatest(0, CAST(round_even(t / 7, 0) AS BIGINT)) AS s, greatest(0, CAST(round_even(value * 100, 0) AS BIGINT)) AS c FROM moments)
SELECT id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS clock,
printf('%d:%02d:%02d.%02d', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100) AS ass_time FROM s""")
def clock_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as people and as subtitles write them."""
    return moments(spark, sf_dir).select("id", T.clock(F.col("t") / 7).alias("clock"), T.ass_time("value").alias("ass_time"))


@query(f"""WITH {TURN_WORDS}, parts AS (SELECT rec_id, k AS idx, k * 20.0 AS start, k * 20.0 + 19 AS "end", k * 15.0 AS origin FROM (SELECT DISTINCT rec_id FROM turn_words), range(3) r(k))
SELECT rec_id, CAST(p.idx AS INTEGER) AS part_idx, word_idx, text, round(p.start + (w.start - origin), 4) AS start, round(p.start + (w."end" - origin), 4) AS "end"
FROM turn_words w JOIN parts p USING (rec_id) WHERE w.start >= origin AND w."end" <= origin + (p."end" - p.start) + 0.05""")
def words_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside three parts of each conversation that overlap at their origin, on the working clock."""
    words, parts = turn_words(spark, sf_dir), _parts(spark, sf_dir)
    return M.words_in_parts(words, parts).select("rec_id", "part_idx", "word_idx", "text", r4("start").alias("start"), r4("end").alias("end"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("idx")
    recs = turn_words(spark, sf_dir).select("rec_id").distinct()
    return recs.select("rec_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx")).select("rec_id", "idx", (k * 20.0).alias("start"), (k * 20.0 + 19).alias("end"), (k * 15.0).alias("origin"))


@query(f"""WITH {TURN_WORDS}, parts AS (SELECT rec_id, k AS idx, k * 20.0 AS start, k * 20.0 + 19 AS "end", k * 15.0 AS origin FROM (SELECT DISTINCT rec_id FROM turn_words), range(3) r(k)),
d AS (SELECT w.rec_id, w.word_idx, w.start AS t, p.idx, origin + (w.start - p.start) AS o, NOT (p.start <= w.start AND w.start < p."end") AS out_, least(abs(p.start - w.start), abs(p."end" - w.start)) AS far FROM turn_words w JOIN parts p USING (rec_id))
SELECT rec_id, word_idx, CAST(idx AS INTEGER) AS part_idx, round(o, 4) AS origin_time FROM d QUALIFY row_number() OVER (PARTITION BY rec_id, word_idx ORDER BY out_, CASE WHEN out_ THEN far ELSE 0 END, idx) = 1""")
def word_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part each word belongs to, or the nearest, and its moment in the source."""
    t = turn_words(spark, sf_dir).select("rec_id", "word_idx", F.col("start").alias("t"))
    return M.part_at(t, _parts(spark, sf_dir)).select("rec_id", "word_idx", "part_idx", r4("origin_time").alias("origin_time"))
