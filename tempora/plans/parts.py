"""Long recordings: shows by time, stretches as parts on a working clock, clips inside parts, word times, states of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import candidates as C
from tempora.operators import segment as S
from tempora.operators import temporal as M
from tempora.operators import work_queue as Q
from tempora.plans import desk
from tempora.plans.adapters import MOMENTS, TURN_LINES, moments, r4, registry, table, turn_lines
from tempora.plans.speech import CANDIDATES, MERGED, _padded, turn_sentences
from tempora.plans.studio import PARTS, _parts
from tempora.plans.work import PIECES, _pieces
from tempora.sources import sinks

QUERIES, ORACLE_SQL, query = registry()


@query(f"""WITH {MOMENTS}, shows AS (SELECT rec_id, t AS "at", 'game ' || (id % 7) AS name FROM moments WHERE kind = 'purchase'), seen AS (SELECT rec_id, id, t FROM moments WHERE kind = 'view')
SELECT s.rec_id, s.id, max_by(g.name, {{'at': g."at", 'name': g.name}}) AS "on" FROM seen s LEFT JOIN shows g ON g.rec_id = s.rec_id AND g."at" <= s.t GROUP BY s.rec_id, s.id""")
def games_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was on at each view: the user's last purchase, as a game."""
    shows = moments(spark, sf_dir, "purchase").select("rec_id", F.col("t").alias("at"), F.concat(F.lit("game "), (F.col("id") % 7).cast("string")).alias("name"))
    return M.on_at(moments(spark, sf_dir, "view").select("rec_id", "id", "t"), shows).select("rec_id", "id", "on")


ON = f"""CASE WHEN rec_id % 3 = 0 THEN '' ELSE 'What was on, by time: ' || CASE WHEN rec_id % 3 = 1 THEN '0:00 Tetris' ELSE '0:00 Tetris; 1:01:05 Chess club' END || chr(10) END"""


@query(desk.ORACLE_SQL["prompt_text"].replace(f"""'Length: ' || {desk.clock("d")} || chr(10) || """, f"""'Length: ' || {desk.clock("d")} || chr(10) || {ON} || """))
def prompt_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about each conversation on which one or two games were played, or none."""
    lines = turn_lines(spark, sf_dir)
    views = lines.where("idx % 4 = 0").select("rec_id", "idx", (F.col("idx") * 10).alias("views"))
    marks = C.line_marks(M.loud_lines(lines, desk.loud_of(spark, sf_dir)), views)
    game = lambda at, name: F.struct(F.lit(at).alias("at"), F.lit(name).alias("name"))
    k = F.col("rec_id") % 3
    games = F.when(k == 1, F.array(game(0.0, "Tetris"))).when(k == 2, F.array(game(0.0, "Tetris"), game(3665.0, "Chess  club")))
    facts = lines.groupBy("rec_id").agg(F.max("end").alias("duration")).select("rec_id", F.lit("Show: Talks\n").alias("brief"), F.concat(F.lit("Talk "), F.col("rec_id").cast("string")).alias("title"), "duration", F.lit("").alias("notes"), games.alias("games"))
    return C.shortlist_prompts(lines, marks, facts, 14, budget=2000)


OWN_PART = f"""{PARTS}, own AS MATERIALIZED (SELECT s.rec_id, s.idx, p.idx AS part FROM sentences s JOIN parts p USING (rec_id) QUALIFY row_number() OVER (PARTITION BY s.rec_id, s.idx ORDER BY NOT (p.start <= s.start AND s.start < p."end"), CASE WHEN p.start <= s.start AND s.start < p."end" THEN 0 ELSE least(abs(p.start - s.start), abs(p."end" - s.start)) END, p.idx) = 1)"""
LOW, HIGH = 5.0, 15.0
IN_PARTS = CANDIDATES.replace("BETWEEN 20 AND 60)", "BETWEEN 5 AND 15 AND NOT EXISTS (SELECT 1 FROM own x JOIN own y ON y.rec_id = x.rec_id AND y.part <> x.part WHERE x.rec_id = a.rec_id AND x.idx = a.idx AND y.idx BETWEEN a.idx AND b.idx))").replace("36.0", "9.0").replace("CASE WHEN total > 600 AND", "CASE WHEN false AND").replace("WITH RECURSIVE", "").replace("scored AS (SELECT", f"{OWN_PART}, scored AS (SELECT", 1)


@query(f"""WITH RECURSIVE {IN_PARTS} SELECT rec_id, first, last, CAST(round(score, 4) AS DOUBLE) AS score FROM candidates""")
def candidates_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best end of a clip of 5 to 15 seconds from each sentence on, inside one part."""
    return C.clip_candidates(turn_sentences(spark, sf_dir), LOW, HIGH, parts=_parts(spark, sf_dir)).select("rec_id", "first", "last", r4("score").alias("score"))


@query(f"""WITH RECURSIVE {IN_PARTS}, asked AS (SELECT rec_id, first, last + first % 5 AS last, score FROM candidates),
sound AS (SELECT a.*, s.start AS a0 FROM asked a JOIN sentences s ON s.rec_id = a.rec_id AND s.idx = a.first JOIN own x ON x.rec_id = a.rec_id AND x.idx = a.first JOIN own y ON y.rec_id = a.rec_id AND y.idx = a.last AND y.part = x.part),
trimmed AS (SELECT s.rec_id, s.first, s.last, s.score, s.a0, arg_max(b."end", b.idx) AS b0, max(b.idx) AS j FROM sound s JOIN sentences b ON b.rec_id = s.rec_id AND b.idx BETWEEN s.first AND s.last AND (b."end" - s.a0 <= 15.01 * 1.1 OR b.idx = s.first) GROUP BY s.rec_id, s.first, s.last, s.score, s.a0)
SELECT rec_id, first, j AS last, CAST(round(greatest(0.0, score - 5 * (last - j)), 4) AS DOUBLE) AS score FROM trimmed WHERE b0 - a0 BETWEEN 5.01 * 0.8 AND 15.01 * 1.1""")
def trimmed_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips asked for with some sentences too many, cut back; those that reach into another part go."""
    s, parts = turn_sentences(spark, sf_dir), _parts(spark, sf_dir)
    picks = C.clip_candidates(s, LOW, HIGH, parts=parts).select("rec_id", F.col("first").alias("pick_id"), "first", (F.col("last") + F.col("first") % 5).alias("last"), F.lit("A title").alias("title"), "score")
    return C.trimmed_back(picks, s, LOW + 0.01, HIGH + 0.01, parts).select("rec_id", "first", "last", r4("score").alias("score"))


# Three windows of each playlist, of which the second ends early; every third file turns out shorter than its pieces.
STRETCHED = f"""{PIECES}, spans AS (SELECT list_id, k AS win, 7.25 + k * 41 AS a, 7.25 + k * 41 + CASE WHEN k = 1 THEN 12.5 ELSE 33 END AS b FROM (SELECT DISTINCT list_id FROM pieces), range(3) r(k)),
met AS (SELECT s.list_id, s.win, p.run, s.a, s.b, min(p.start) AS begin_, arg_max(p.start + p.duration, p.seq) AS stop, min(p.seq) AS first FROM spans s JOIN pieces p ON p.list_id = s.list_id AND p.start < s.b + 1 AND p.start + p.duration > s.a - 1 GROUP BY ALL),
cut AS (SELECT *, greatest(a, begin_) AS origin, least(b, begin_ + CASE WHEN first % 3 = 0 THEN 25.5 ELSE stop - begin_ END) AS b2 FROM met WHERE stop - begin_ >= 12),
stretched AS MATERIALIZED (SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY win, run) - 1 AS idx, run, origin - begin_ AS offset_, origin, b2 - origin AS length, win FROM cut WHERE b2 - origin >= 12)"""


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pieces(spark, sf_dir).withColumnRenamed("list_id", "rec_id")
    k = F.col("idx")
    windows = p.select("rec_id").distinct().withColumn("idx", F.explode(F.array(*map(F.lit, range(3))))).select("rec_id", "idx", (7.25 + k * 41).alias("start"), (7.25 + k * 41 + F.when(k == 1, 12.5).otherwise(33.0)).alias("end"), F.concat(F.lit("window "), k.cast("string")).alias("why"))
    runs = p.select("rec_id", "run", "seq", "start", (F.col("start") + F.col("duration")).alias("end"), F.when(F.col("seq") % 3 == 0, 25.5).alias("length"))
    return M.stretch_parts(windows, runs)


@query(f"""WITH {STRETCHED} SELECT list_id AS rec_id, CAST(idx AS INTEGER) AS idx, run, printf('%02d', idx + 1) AS file, round(offset_, 4) AS offset_, round(origin, 4) AS origin, round(length, 4) AS length, 'window ' || win AS why FROM stretched""")
def stretch_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is looked at closely of three windows of each playlist."""
    return _stretches(spark, sf_dir).select("rec_id", "idx", "run", "file", r4("offset").alias("offset_"), r4("origin").alias("origin"), r4("length").alias("length"), "why")


LAID_PARTS = f"""{STRETCHED}, whole AS (SELECT *, CAST(round_even(length * 16000, 0) AS BIGINT) AS n FROM stretched), laid AS (SELECT *, coalesce(sum(n + 16000) OVER (PARTITION BY list_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM whole)"""


@query(f"""WITH {LAID_PARTS} SELECT list_id AS rec_id, CAST(idx AS INTEGER) AS idx, round(d / 16000, 4) AS start, round((d + n) / 16000, 4) AS "end", round(origin, 4) AS origin FROM laid""")
def laid_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stretches on the working clock."""
    return M.laid_parts(_stretches(spark, sf_dir)).select("rec_id", "idx", r4("start").alias("start"), r4("end").alias("end"), r4("origin").alias("origin"))


@query(f"""WITH {LAID_PARTS}, number AS (SELECT list_id, idx, win, round(CAST(d AS DOUBLE) / 16000, 3) AS s, round(CAST(d + n AS DOUBLE) / 16000, 3) AS e, round(CAST(origin AS DOUBLE), 3) AS o, round(CAST(offset_ AS DOUBLE), 3) AS f FROM laid)
SELECT list_id AS rec_id, '{{"version":1,"language":"en","duration":60.0,"model":"small","pauses":{{}},"parts":[' || string_agg('{{"index":' || idx || ',"start":' || s || ',"end":' || e || ',"origin":' || o || ',"file":"' || printf('%02d', idx + 1) || '","offset":' || f || ',"why":"window ' || win || '"}}', ',' ORDER BY idx) || '],"words":[["a",0.0,0.3],["b",0.5,0.75]]}}' AS json FROM number GROUP BY list_id""")
def transcripts_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript file of two words with the parts of each playlist."""
    parts = M.laid_parts(_stretches(spark, sf_dir))
    recs = parts.select("rec_id").distinct()
    words = recs.select("rec_id", F.explode(F.array(F.struct(F.lit(0).alias("word_idx"), F.lit("a").alias("text"), F.lit(0.0).alias("start"), F.lit(0.3).alias("end")), F.struct(F.lit(1).alias("word_idx"), F.lit("b").alias("text"), F.lit(0.5).alias("start"), F.lit(0.75).alias("end")))).alias("w")).select("rec_id", "w.*")
    facts = recs.select("rec_id", F.lit("en").alias("language"), F.lit(60.0).alias("duration"), F.lit("small").alias("model"))
    return sinks.transcript_json(words, words.select("rec_id", "word_idx", F.lit(0.0).alias("length")).limit(0), facts, parts)


# Moved a little, so that no time lies between two of four decimals.
@query(f"""WITH {TURN_LINES}, w AS (SELECT rec_id, idx, start + CAST(0.0000137 AS DOUBLE) AS start, "end" + CAST(0.0000137 AS DOUBLE) AS "end", list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM turn_lines), u AS (SELECT rec_id, idx, start, "end", unnest(w) AS text, generate_subscripts(w, 1) - 1 AS pos FROM w),
c AS (SELECT *, sum(length(text) + 1.5) OVER (PARTITION BY rec_id, idx ORDER BY pos) AS upto, sum(length(text) + 1.5) OVER (PARTITION BY rec_id, idx) AS total FROM u)
SELECT rec_id, idx, CAST(pos AS INTEGER) AS pos, text, round(start + CAST(upto - length(text) - 1.5 AS DOUBLE) / CAST(total AS DOUBLE) * ("end" - start), 4) AS start, round(start + CAST(upto AS DOUBLE) / CAST(total AS DOUBLE) * ("end" - start) - 0.02, 4) AS "end" FROM c""")
def word_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn, which share its time by their length."""
    lines = turn_lines(spark, sf_dir).withColumn("start", F.col("start") + 0.0000137).withColumn("end", F.col("end") + 0.0000137)
    return S.word_times(lines).select("rec_id", "idx", "pos", "text", r4("start").alias("start"), r4("end").alias("end"))


# Each customer's orders are clips; every third run is on a stream, some of which were only begun.
@query(f"""WITH clips AS (SELECT o_custkey AS rec_id, list({{'rank': row_number, 'title': 'Order ' || o_orderkey}} ORDER BY row_number) AS clips FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_number FROM orders) GROUP BY o_custkey),
r AS (SELECT rec_id, clips, CAST(3000 + rec_id % 50 * 100 AS DOUBLE) AS length, CAST(3600 AS DOUBLE) AS skimmed, CAST(rec_id % 9 AS INTEGER) AS stretches, CASE WHEN rec_id % 2 = 0 THEN 'A note.' ELSE '' END AS note FROM clips),
n AS (SELECT *, CASE WHEN rec_id % 3 = 0 AND length > skimmed + 60 THEN concat_ws(' ', nullif(note, ''), 'Only the first ' || {desk.clock("skimmed")} || ' of this ' || {desk.clock("length")} || ' stream was looked at.') ELSE note END AS told FROM r)
SELECT rec_id, CAST(CASE WHEN rec_id % 3 = 0 THEN to_json({{'client': 'acme', 'show': 'Show', 'title': '', 'source': '', 'picker': 'heuristic', 'model': '', 'clips': clips, 'recording': {{'platform': 'twitch', 'channel': 'c' || rec_id, 'length': length, 'skimmed': skimmed, 'stretches': stretches}}, 'note': told}})
  ELSE to_json({{'client': 'acme', 'show': 'Show', 'title': '', 'source': '', 'picker': 'heuristic', 'model': '', 'clips': clips, 'note': told}}) END AS VARCHAR) AS manifest FROM n""")
def stream_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of each customer's clips, with what is known of the stream they are from."""
    from pyspark.sql import Window

    rec = F.col("rec_id")
    clips = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rec_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"))
    length = (3000 + rec % 50 * 100).cast("double")
    stream = F.struct(F.lit("twitch").alias("platform"), F.concat(F.lit("c"), rec.cast("string")).alias("channel"), length.alias("length"), F.lit(3600.0).alias("skimmed"), (rec % 9).cast("int").alias("stretches"))
    runs = clips.select("rec_id").distinct().select("rec_id", F.lit("acme").alias("client"), F.lit("Show").alias("show"), *[F.lit(v).alias(c) for c, v in (("title", ""), ("source", ""), ("picker", "heuristic"), ("model", ""))], F.array(F.when(rec % 2 == 0, "A note.").otherwise("")).alias("notes"), F.when(rec % 3 == 0, stream).alias("recording"))
    return sinks.manifests(clips, runs, ("rank", "title"))


# Each order is a request whose labels its key tells; its lines are what happens to it, in order.
STUCK, SILENT, FAILED = (x.replace("'", "''") for x in (Q.STUCK, Q.SILENT, Q.FAILED))
HEAD, MIDDLE, TAIL = FAILED.replace("\n", "'||chr(10)||'").split("%s")
BEGIN = "CASE o_orderkey % 4 WHEN 0 THEN ['episode', 'processing'] WHEN 1 THEN ['episode', 'failed'] ELSE ['episode'] END"


@query(f"""WITH RECURSIVE e AS (SELECT l_orderkey AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'publish' WHEN 1 THEN 'fail' ELSE 'start' END AS kind,
  CASE WHEN l_linenumber % 2 = 0 THEN '  broken ' || l_linenumber || ' ' ELSE '' END AS reason, CAST(l_linenumber AS BIGINT) AS seq FROM lineitem),
f AS (
  SELECT o_orderkey AS number, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS seq, '' AS kind, '' AS action, CAST([] AS VARCHAR[]) AS added, CAST([] AS VARCHAR[]) AS removed, {BEGIN} AS labels, CAST(NULL AS VARCHAR) AS comment FROM orders
  UNION ALL
  SELECT number, k, seq, kind, action, list_filter(plus, lambda x: NOT list_contains(was, x)), list_filter(minus, lambda x: list_contains(was, x)),
    list_concat(list_filter(was, lambda x: NOT list_contains(minus, x)), list_filter(plus, lambda x: NOT list_contains(was, x) OR list_contains(minus, x))), CASE WHEN action = 'fail' THEN '{HEAD}' || CASE WHEN kind = 'start' THEN '{STUCK}' WHEN trim(reason) = '' THEN '{SILENT}' ELSE trim(reason) END || '{MIDDLE}' || 'https://example.org/run/' || k || '{TAIL}' END
  FROM (SELECT *, CASE action WHEN 'publish' THEN ['clipped'] WHEN 'fail' THEN ['failed'] WHEN 'start' THEN ['processing'] ELSE CAST([] AS VARCHAR[]) END AS plus, CASE action WHEN 'publish' THEN ['processing', 'failed'] WHEN 'fail' THEN ['processing'] WHEN 'start' THEN ['failed'] ELSE CAST([] AS VARCHAR[]) END AS minus
    FROM (SELECT e.number, e.k, e.seq, e.kind, e.reason, f.labels AS was, CASE WHEN e.kind <> 'start' THEN e.kind WHEN list_contains(f.labels, 'clipped') OR list_contains(f.labels, 'failed') THEN 'skip' WHEN list_contains(f.labels, 'processing') THEN 'fail' ELSE 'start' END AS action FROM f JOIN e ON e.number = f.number AND e.k = f.k + 1))
) SELECT number, k AS seq, kind, action, array_to_string(added, ' ') AS added, array_to_string(removed, ' ') AS removed, array_to_string(labels, ' ') AS labels, comment FROM f WHERE k > 0""")
def label_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What starting, publishing and failing do to the labels of each order."""
    from pyspark.sql import Window

    key = F.col("o_orderkey")
    names = lambda *n: F.array(*map(F.lit, n))
    issues = table(spark, sf_dir, "orders").select(key.alias("number"), F.when(key % 4 == 0, names("episode", "processing")).when(key % 4 == 1, names("episode", "failed")).otherwise(names("episode")).alias("labels"))
    # named before they are dealt, so that numbering and labelling share one deal
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), "l_linenumber", "l_partkey", "l_suppkey")
    kind = (F.col("number") + F.col("l_linenumber")) % 4
    seq = F.row_number().over(Window.partitionBy("number").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    events = lines.withColumn("seq", seq).select(
        "number", "seq", F.when(kind == 0, "publish").when(kind == 1, "fail").otherwise("start").alias("kind"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("  broken "), F.col("l_linenumber").cast("string"), F.lit(" "))).otherwise("").alias("reason"), F.concat(F.lit("https://example.org/run/"), F.col("seq").cast("string")).alias("log"),
    )
    join = lambda c: F.array_join(c, " ").alias(c)
    return Q.label_steps(issues, events).select("number", "seq", "kind", "action", join("added"), join("removed"), join("labels"), "comment")
