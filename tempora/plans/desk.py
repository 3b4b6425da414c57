"""Texts that people and models read, requests, listings and media descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import glyphs as G
from tempora.functions import links as K
from tempora.functions import text as T
from tempora.operators import candidates as C
from tempora.operators import segment as S
from tempora.operators import temporal as M
from tempora.operators import work_queue as Q
from tempora.plans.adapters import TURN_LINES, TURN_WORDS, r4, registry, table, turn_lines, turn_words
from tempora.plans.signals import LOUD, loud_of
from tempora.plans.speech import CANDIDATES, CHUNKED, GREEDY, HEADED, SENTENCES, chunks_by, talks, titled_clips, turn_sentences
from tempora.plans.studio import PARTS, _parts
from tempora.sources import playlists as H
from tempora.sources import readers as R
from tempora.sources import sinks

QUERIES, ORACLE_SQL, query = registry()


def clock(x: str) -> str:
    """SQL of a clock."""
    n = f"greatest(0, CAST(round_even({x}, 0) AS BIGINT))"
    return f"(CASE WHEN {n} >= 3600 THEN printf('%d:%02d:%02d', {n} // 3600, {n} % 3600 // 60, {n} % 60) ELSE printf('%d:%02d', {n} // 60, {n} % 60) END)"


# White space of any script, as RE2 has to be told.
ANY_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(f"""WITH {TURN_LINES}, p AS (SELECT rec_id, idx, start, "end", CASE WHEN idx % 5 = 1 THEN 'so it  goes' WHEN idx % 5 = 2 THEN chr(8195) || 'so' || chr(160) || 'it' || chr(12288) || chr(28) || 'goes' || chr(11) WHEN idx % 15 = 8 THEN chr(12288) || chr(133) ELSE text END AS text, -((idx * 7 + rec_id) % 20) / 10.0 AS lp, (idx % 10) / 10.0 AS ns FROM turn_lines),
k AS (SELECT *, trim(regexp_replace(text, '{ANY_SPACE}+', ' ', 'g')) AS t FROM p), f AS (SELECT * FROM k WHERE t <> '' AND NOT (lp < -1.3 OR ns > 0.85 AND lp < -0.8)),
g AS (SELECT *, lag(t) OVER (PARTITION BY rec_id ORDER BY idx) AS was FROM f)
SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY idx) - 1 AS INTEGER) AS idx, round(greatest(start, "end" - (0.45 * len(string_split(t, ' ')) + 1.5)), 4) AS start, round("end", 4) AS "end", t AS text FROM g WHERE was IS NULL OR was <> t""")
def rough_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a quick model's phrases, without guesses and repeats, whatever white space they hold."""
    i = F.col("idx")
    said = F.when(i % 5 == 1, "so it  goes").when(i % 5 == 2, "\u2003so\u00a0it\u3000\x1cgoes\x0b").when(i % 15 == 8, "\u3000\x85").otherwise(F.col("text"))
    p = turn_lines(spark, sf_dir).withColumn("text", said)
    p = p.withColumn("logprob", -((i * 7 + F.col("rec_id")) % 20) / 10.0).withColumn("no_speech", (i % 10) / 10.0)
    return S.rough_lines(p).select("rec_id", "idx", r4("start").alias("start"), r4("end").alias("end"), "text")


@query(f"""WITH RECURSIVE {CANDIDATES}, asked AS (SELECT rec_id, first, last + first % 9 AS last, score FROM candidates WHERE first % 7 <> 3),
sound AS (SELECT a.*, s.start AS a0 FROM asked a JOIN sentences s ON s.rec_id = a.rec_id AND s.idx = a.first WHERE EXISTS (SELECT 1 FROM sentences z WHERE z.rec_id = a.rec_id AND z.idx = a.last)),
trimmed AS (SELECT s.rec_id, s.first, s.last, s.score, s.a0, arg_max(b."end", b.idx) AS b0, max(b.idx) AS j FROM sound s JOIN sentences b ON b.rec_id = s.rec_id AND b.idx BETWEEN s.first AND s.last AND (b."end" - s.a0 <= 60.01 * 1.1 OR b.idx = s.first) GROUP BY s.rec_id, s.first, s.last, s.score, s.a0)
SELECT rec_id, first, j AS last, CAST(round(greatest(0.0, score - 5 * (last - j)), 4) AS DOUBLE) AS score FROM trimmed WHERE b0 - a0 BETWEEN 20.01 * 0.8 AND 60.01 * 1.1""")
def trimmed_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips asked for with some sentences too many, cut back; without a title, or beyond the last sentence, they go."""
    s = turn_sentences(spark, sf_dir)
    picks = C.clip_candidates(s).select("rec_id", F.col("first").alias("pick_id"), "first", (F.col("last") + F.col("first") % 9).alias("last"), F.when(F.col("first") % 7 == 3, "").otherwise("A title").alias("title"), "score")
    return C.trimmed_back(picks, s, 20.01, 60.01).select("rec_id", "first", "last", r4("score").alias("score"))


# Lines of 28 characters: every way to break a title, and the fold that fills lines where no way fits.
@query(f"""WITH RECURSIVE {SENTENCES}, w AS (SELECT rec_id, idx, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM sentences),
t AS MATERIALIZED (SELECT rec_id, idx, w, len(w) AS n, length(array_to_string(w, ' ')) AS c FROM w WHERE len(w) > 0),
two AS (SELECT rec_id, idx, min({{'widest': greatest(length(array_to_string(w[1:a], ' ')), length(array_to_string(w[a + 1:n], ' '))), 'a': a}}) AS m FROM (SELECT *, unnest(range(1, n)) AS a FROM t WHERE c > 28 AND c <= 57) GROUP BY rec_id, idx),
three AS (SELECT rec_id, idx, min({{'widest': greatest(length(array_to_string(w[1:a], ' ')), length(array_to_string(w[a + 1:b], ' ')), length(array_to_string(w[b + 1:n], ' '))), 'a': a, 'b': b}}) AS m FROM (SELECT *, unnest(range(a + 1, n)) AS b FROM (SELECT *, unnest(range(1, n - 1)) AS a FROM t WHERE c > 28 AND c <= 86)) GROUP BY rec_id, idx),
fill AS (
  SELECT rec_id, idx, w, n, 1 AS k, [w[1]] AS lines FROM t
  UNION ALL
  SELECT rec_id, idx, w, n, k + 1, CASE WHEN length(lines[-1] || ' ' || w[k + 1]) > 28 THEN list_append(lines, w[k + 1]) ELSE list_append(lines[:-2], lines[-1] || ' ' || w[k + 1]) END FROM fill WHERE k < n
), filled AS (SELECT rec_id, idx, lines[1:3] AS l FROM fill WHERE k = n)
SELECT t.rec_id, t.idx, CASE WHEN c <= 28 THEN array_to_string(w, ' ') WHEN two.m.widest <= 28 THEN array_to_string(w[1:two.m.a], ' ') || ' / ' || array_to_string(w[two.m.a + 1:n], ' ')
WHEN three.m.widest <= 28 THEN array_to_string(w[1:three.m.a], ' ') || ' / ' || array_to_string(w[three.m.a + 1:three.m.b], ' ') || ' / ' || array_to_string(w[three.m.b + 1:n], ' ')
ELSE array_to_string(list_append(l[:-2], rtrim(l[-1], '.,;:') || '…'), ' / ') END AS lines
FROM t LEFT JOIN two ON two.rec_id = t.rec_id AND two.idx = t.idx LEFT JOIN three ON three.rec_id = t.rec_id AND three.idx = t.idx JOIN filled f ON f.rec_id = t.rec_id AND f.idx = t.idx""")
def wrapped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence as a headline of three lines at most."""
    s = turn_sentences(spark, sf_dir).where(F.trim("text") != "")
    return s.select("rec_id", "idx", F.array_join(G.wrapped_title("text", 48.0), " / ").alias("lines"))


def wrapped_sql(name: str, source: str, room: int, gap: str) -> str:
    """CTEs that end in ``name`` (rec_id, idx, lines): every way to break w (words) of source (rec_id, idx, w, ww (widths), n), and the fold that fills lines where none fits."""
    wide = lambda a, b: f"(list_sum(ww[{a}:{b}]) + ({b} - ({a})) * {gap})"
    line = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"
    return f"""{name}_two AS (SELECT rec_id, idx, min({{'widest': greatest({wide(1, "a")}, {wide("a + 1", "n")}), 'a': a}}) AS m FROM (SELECT *, unnest(range(1, n)) AS a FROM {source} WHERE {wide(1, "n")} <= 2 * {room} + {gap}) GROUP BY rec_id, idx),
{name}_three AS (SELECT rec_id, idx, min({{'widest': greatest({wide(1, "a")}, {wide("a + 1", "b")}, {wide("b + 1", "n")}), 'a': a, 'b': b}}) AS m FROM (SELECT *, unnest(range(a + 1, n)) AS b FROM (SELECT *, unnest(range(1, n - 1)) AS a FROM {source} WHERE {wide(1, "n")} <= 3 * {room} + 2 * {gap})) GROUP BY rec_id, idx),
{name}_fill AS (
  SELECT rec_id, idx, w, ww, n, 1 AS k, [w[1]] AS lines, ww[1] AS used FROM {source}
  UNION ALL
  SELECT rec_id, idx, w, ww, n, k + 1, CASE WHEN used + {gap} + ww[k + 1] > {room} THEN list_append(lines, w[k + 1]) ELSE list_append(lines[:-2], lines[-1] || ' ' || w[k + 1]) END, CASE WHEN used + {gap} + ww[k + 1] > {room} THEN ww[k + 1] ELSE used + {gap} + ww[k + 1] END FROM {name}_fill WHERE k < n
), {name} AS (
  SELECT t.rec_id, t.idx, CASE WHEN {wide(1, "n")} <= {room} THEN [{line(1, "n")}] WHEN two.m.widest <= {room} THEN [{line(1, "two.m.a")}, {line("two.m.a + 1", "n")}]
  WHEN three.m.widest <= {room} THEN [{line(1, "three.m.a")}, {line("three.m.a + 1", "three.m.b")}, {line("three.m.b + 1", "n")}] ELSE list_append(f.lines[1:3][:-2], rtrim(f.lines[1:3][-1], '.,;:') || '…') END AS lines
  FROM {source} t LEFT JOIN {name}_two two ON two.rec_id = t.rec_id AND two.idx = t.idx LEFT JOIN {name}_three three ON three.rec_id = t.rec_id AND three.idx = t.idx
  JOIN (SELECT rec_id, idx, any_value(lines) AS lines FROM {name}_fill WHERE k = n GROUP BY rec_id, idx) f ON f.rec_id = t.rec_id AND f.idx = t.idx
)"""


# A made font: 1000 units to the em, advances of the code points from 33 on by the keys and sizes of parts; no space, no letters beyond ASCII.
METRICS = """metrics AS (SELECT map(list(code), list(units)) AS m FROM (SELECT 32 + p_partkey AS code, 300 + (p_size * 37 + p_partkey * 13) % 700 AS units FROM part WHERE p_partkey BETWEEN 1 AND 94))"""
ADVANCES = "list_sum(list_transform(string_split({}, ''), lambda c: coalesce(m[ord(c)] * 100, 62000)))"


def made_font(spark: SparkSession, sf_dir: str) -> G.Glyphs:
    p = table(spark, sf_dir, "part").where("p_partkey between 1 and 94")
    return G.Glyphs.of(p.select((32 + F.col("p_partkey")).alias("code"), (300 + (F.col("p_size") * 37 + F.col("p_partkey") * 13) % 700).alias("units")), 1000)


@query(f"""WITH RECURSIVE {SENTENCES}, {METRICS}, w AS (SELECT rec_id, idx, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM sentences),
sizes AS MATERIALIZED (SELECT word, {ADVANCES.format("word")} AS wide FROM (SELECT DISTINCT unnest(w) AS word FROM w), metrics),
t AS MATERIALIZED (SELECT rec_id, idx, list(word ORDER BY k) AS w, list(CAST(wide AS BIGINT) ORDER BY k) AS ww, CAST(count(*) AS BIGINT) AS n FROM (SELECT rec_id, idx, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM w) JOIN sizes USING (word) GROUP BY rec_id, idx),
{wrapped_sql("wrapped", "t", 1750000, "62000")} SELECT rec_id, idx, array_to_string(lines, ' / ') AS lines FROM wrapped""")
def titles_by_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence as a headline in a font of letters of unlike widths."""
    s = turn_sentences(spark, sf_dir).where(F.trim("text") != "")
    return s.select("rec_id", "idx", F.array_join(G.wrapped_title("text", 48.0, glyphs=made_font(spark, sf_dir)), " / ").alias("lines"))


@query(f"""WITH RECURSIVE {METRICS}, {chunks_by(f"CAST({ADVANCES.format('s')} AS BIGINT)", "62000", "w.chars + 62000 + x.wide > 1250000", ", metrics")}
SELECT rec_id, CAST(chunk AS BIGINT) AS chunk, CAST(row_number() OVER (PARTITION BY rec_id, chunk ORDER BY word_idx) - 1 AS INTEGER) AS pos, text FROM chunked""")
def captions_by_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of at most four words that fit a line in a font of letters of unlike widths."""
    return S.caption_chunks(turn_words(spark, sf_dir), uppercase=False, glyphs=made_font(spark, sf_dir)).select("rec_id", "chunk", "pos", "text")


SHOWN_TITLE = """translate(regexp_replace(trim(replace(replace(trim(text), '—', ''), '–', '-'), '"“”‘’()[]…'), '^[.,;:]+|[.,;:]+$', '', 'g'), '{}\\', '()/')"""


@query(f"""WITH RECURSIVE {SENTENCES}, w AS (SELECT rec_id, idx, list_filter(regexp_split_to_array({SHOWN_TITLE}, '\\s+'), lambda x: x <> '') AS w FROM sentences WHERE idx % 5 > 0),
t AS MATERIALIZED (SELECT rec_id, idx, w, list_transform(w, lambda x: length(x) * 62) AS ww, CAST(len(w) AS BIGINT) AS n FROM w WHERE len(w) > 0),
{wrapped_sql("usual", "t", 1750, "62")}, {wrapped_sql("small", "t", 2048, "62")},
l AS (SELECT u.rec_id, u.idx, len(u.lines) > 2 AS small, CASE WHEN len(u.lines) > 2 THEN s.lines ELSE u.lines END AS lines, CASE WHEN len(u.lines) > 2 THEN 41 ELSE 48 END AS size, CAST(u.idx % 5 AS DOUBLE) AS until, CAST(3.2 AS DOUBLE) AS duration, 200 + 50 * (u.idx % 4) AS title_y, CASE WHEN u.idx % 3 = 0 THEN CAST(300 + u.idx % 60 AS DOUBLE) END AS floor_ FROM usual u JOIN small s ON s.rec_id = u.rec_id AND s.idx = u.idx),
b AS (SELECT *, len(lines) * size * CAST(1.2 AS DOUBLE) + 26 AS block, CAST(round_even(least(until, duration) * 100, 0) AS BIGINT) AS cs FROM l)
SELECT rec_id, CAST(idx AS BIGINT) AS clip, printf('Dialogue: 1,0:00:00.00,0:%02d:%02d.%02d,Title,,0,0,0,,', cs // 6000, cs % 6000 // 100, cs % 100) || '{{\\an5\\pos(540,' || CAST(trunc(greatest(CASE WHEN floor_ IS NULL THEN title_y ELSE least(CAST(title_y AS DOUBLE), floor_ - block / 2) END, 120 + block / 2)) AS BIGINT) || ')'
|| CASE WHEN small THEN '\\fs49.2' ELSE '' END || CASE WHEN until < duration - CAST(0.3 AS DOUBLE) THEN '\\fad(0,250)' ELSE '' END || '}}' || array_to_string(lines, '\\N') AS event FROM b""")
def headline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline of each sentence, shown for one to four seconds of a clip of 3.2."""
    i = F.col("idx")
    s = turn_sentences(spark, sf_dir).where("idx % 5 > 0").withColumn("shown", T.display_word("text", False)).where(F.size(F.filter(F.split("shown", r"\s+"), lambda w: w != "")) > 0)
    clips = s.select("rec_id", i.alias("clip"), F.col("text").alias("title"), F.lit(3.2).alias("duration"), (200 + 50 * (i % 4)).alias("title_y"), F.when(i % 3 == 0, (300 + i % 60).cast("double")).alias("floor"), (i % 5).cast("double").alias("until"))
    return sinks.headline_events(clips)


@query(r"""WITH t AS (SELECT conv_id AS rec_id, turn, text, list_filter(list_transform(list_concat(['#Show', 'new one'], regexp_split_to_array(text, ' ')), lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}_]', '', 'g'))), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL)
SELECT rec_id, turn, CASE WHEN turn % 2 = 0 THEN trim(left(text, 30), ' ') || chr(10) || chr(10) ELSE '' END || array_to_string(list_transform(list_filter(w, lambda x, i: list_position(w, x) = i)[1:8], lambda x: '#' || x), ' ') AS post FROM t WHERE turn % 2 = 1 OR trim(left(text, 30), ' ') <> ''""")
def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caption and eight hashtags for each turn."""
    c = table(spark, sf_dir, "conversations").where("text is not null").where("turn % 2 = 1 or trim(left(text, 30)) <> ''")
    caption = F.when(F.col("turn") % 2 == 0, F.left("text", F.lit(30)))
    return c.select(F.col("conv_id").alias("rec_id"), "turn", T.post_text(caption, F.array(F.lit("#Show"), F.lit("new one")), F.split("text", " ")).alias("post"))


@query(r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title', 1), '\s+', ' ', 'g')), '') AS title FROM pages""")
def page_title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each page."""
    return R.page_titles(table(spark, sf_dir, "pages"))


MARKED = f"""{CHUNKED}, {LOUD}, heard AS (SELECT DISTINCT t.rec_id, t.idx FROM turn_lines t JOIN loud l ON l.rec_id = t.rec_id AND t.start <= l."end" + 1 AND t."end" >= l."at" - 1),
marked AS (SELECT c.rec_id, c.idx, c.chunk, c.n, c.start, c."end", c.text, concat_ws(' ', CASE WHEN h.idx IS NOT NULL THEN '{{LOUD}}' END, CASE WHEN c.idx % 4 = 0 THEN '{{CLIPPED ' || (c.idx * 10) || '}}' END) AS marks FROM chunked_lines c LEFT JOIN heard h ON h.rec_id = c.rec_id AND h.idx = c.idx)"""


@query(f"""WITH RECURSIVE {MARKED}, whole AS (SELECT rec_id, max("end") AS d FROM turn_lines GROUP BY rec_id),
per AS (SELECT rec_id, chunk, any_value(n) AS n, count(*) AS k, min(idx) AS a, max(idx) AS b, string_agg('[' || idx || '] ' || {clock("start")} || ' ' || text || CASE WHEN marks = '' THEN '' ELSE ' ' || marks END, chr(10) ORDER BY idx) AS body FROM marked GROUP BY rec_id, chunk)
SELECT rec_id, chunk, '<brief>' || chr(10) || 'Show: Talks' || chr(10) || '</brief>' || chr(10) || chr(10) || '<request>' || chr(10) || 'Shortlist up to ' || greatest(3, CAST(round_even(14 * k / n, 0) AS INTEGER) + 2) || ' stretches, best first. The clips cut from them will each run 20 to 60 seconds.' || chr(10)
|| 'Recording: Talk ' || rec_id || chr(10) || 'Length: ' || {clock("d")} || chr(10) || CASE WHEN k < n THEN 'This is one part of the recording: lines ' || a || ' to ' || b || '.' || chr(10) ELSE '' END || '</request>' || chr(10) || chr(10) || '<transcript>' || chr(10) || body || chr(10) || '</transcript>' AS prompt FROM per JOIN whole USING (rec_id)""")
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about the turns of each conversation, with marks of loud and clipped turns."""
    lines = turn_lines(spark, sf_dir)
    views = lines.where("idx % 4 = 0").select("rec_id", "idx", (F.col("idx") * 10).alias("views"))
    marks = C.line_marks(M.loud_lines(lines, loud_of(spark, sf_dir)), views)
    facts = lines.groupBy("rec_id").agg(F.max("end").alias("duration")).select("rec_id", F.lit("Show: Talks\n").alias("brief"), F.concat(F.lit("Talk "), F.col("rec_id").cast("string")).alias("title"), "duration", F.lit("").alias("notes"))
    return C.shortlist_prompts(lines, marks, facts, 14, budget=2000)


@query(f"""WITH RECURSIVE {SENTENCES}, {PARTS}, met AS (SELECT s.rec_id, s.idx, s.text, p.idx AS part, p.origin, p.origin + (s.start - p.start) AS o, NOT (p.start <= s.start AND s.start < p."end") AS out_, least(abs(p.start - s.start), abs(p."end" - s.start)) AS far FROM (SELECT rec_id, idx, text, start + 0.013 AS start FROM sentences) s JOIN parts p USING (rec_id)),
own AS (SELECT *, lag(part) OVER (PARTITION BY rec_id ORDER BY idx) AS was FROM (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY rec_id, idx ORDER BY out_, CASE WHEN out_ THEN far ELSE 0 END, part) = 1)),
rows AS (SELECT rec_id, idx, CASE WHEN was IS NULL OR was <> part THEN chr(10) || '--- Stretch ' || (part + 1) || ', starting ' || {clock("origin")} || ' into the recording.' || CASE WHEN part = 1 THEN ' First pass: loud' ELSE '' END || ' ---' || chr(10) ELSE '' END || '[' || idx || '] ' || {clock("o")} || ' ' || text AS line FROM own)
SELECT rec_id, '<brief>' || chr(10) || '</brief>' || chr(10) || chr(10) || '<request>' || chr(10) || 'Pick the 5 strongest moments, best first. Each must run between 20 and 60 seconds.' || chr(10) || 'This is a long recording. You are seeing 3 stretches of it that a first pass shortlisted, each under its own heading. A clip must come from a single stretch.' || chr(10)
|| 'Editor''s notes for this episode: be brief' || chr(10) || '</request>' || chr(10) || chr(10) || '<transcript>' || chr(10) || trim(string_agg(line, chr(10) ORDER BY idx), chr(10)) || chr(10) || '</transcript>' AS prompt FROM rows GROUP BY rec_id""")
def clip_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about the sentences of each conversation, under a heading for each part."""
    parts = _parts(spark, sf_dir).withColumn("why", F.when(F.col("idx") == 1, "loud").otherwise(""))
    s = turn_sentences(spark, sf_dir).withColumn("start", F.col("start") + 0.013)
    facts = s.select("rec_id").distinct().select("rec_id", F.lit("").alias("brief"), F.lit("").alias("title"), F.lit(0.0).alias("duration"), F.lit("be  brief").alias("notes"))
    return C.clip_prompts(s, parts, facts, 5)


SHEET = f"""{GREEDY}, {HEADED}, timed AS (SELECT c.*, a.start + 0.013 AS start, b."end" + 0.027 AS "end" FROM clips c JOIN sentences a ON a.rec_id = c.rec_id AND a.idx = c.first JOIN sentences b ON b.rec_id = c.rec_id AND b.idx = c.last)"""


def _sheet_clips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    timed = titled_clips(spark, sf_dir).withColumn("start", F.col("start") + 0.013).withColumn("end", F.col("end") + 0.027)
    watch = F.when(F.col("rank") % 2 == 0, F.concat(F.lit("https://example.org/at/"), F.col("rank").cast("string"))).otherwise("")
    clips = timed.select(
        "rec_id", "rank", F.concat("title", F.when(F.col("rank") == 1, " | first").otherwise("")).alias("title"), F.format_string("%02d-clip.mp4", "rank").alias("file"), (F.col("end") - F.col("start")).alias("duration"), F.col("start").alias("source_start"), F.col("end").alias("source_end"),
        (F.col("rank") % 3 * 0.25).alias("trimmed"), F.lit("#talk").alias("post"), F.when(F.col("rank") % 2 == 1, "its opening").otherwise("").alias("why"), F.col("caption").alias("text"), watch.alias("watch"),
    )
    name = F.col("rec_id").cast("string")
    runs = talks(spark, sf_dir).select(
        "rec_id", F.lit("Talks").alias("show"), F.when(F.col("rec_id") % 2 == 0, F.concat(F.lit("Talk "), name)).otherwise("").alias("title"), F.lit("heuristic").alias("picker"), F.lit("").alias("model"), F.when(F.col("rec_id") % 3 == 0, "A note.").otherwise("").alias("note"),
        F.concat(F.lit("https://example.org/r/"), name).alias("release_url"), F.concat(F.lit("https://example.org/d/"), name).alias("download_url"),
    )
    return clips, runs


NL = "chr(10)"


@query(f"""WITH RECURSIVE {SHEET} SELECT rec_id, '# Talks' || CASE WHEN rec_id % 2 = 0 THEN ' — Talk ' || rec_id ELSE '' END || {NL} || {NL} || count(*) || CASE WHEN count(*) = 1 THEN ' clip' ELSE ' clips' END || ', best first. Picked by the built-in fallback picker.' || {NL} || CASE WHEN rec_id % 3 = 0 THEN {NL} || '> A note.' || {NL} ELSE '' END
|| string_agg({NL} || '## ' || rank || '. ' || title || CASE WHEN rank = 1 THEN ' | first' ELSE '' END || {NL} || {NL} || printf('`%02d-clip.mp4` · ', rank) || {clock('"end" - start')} || ' · from ' || {clock("start")} || ' to ' || {clock('"end"')} || ' of the episode' || CASE WHEN rank % 2 = 0 THEN ' ([watch it there](https://example.org/at/' || rank || '))' ELSE '' END
|| CASE WHEN rank % 3 = 2 THEN ' · 0.5s of pauses removed' ELSE '' END || {NL} || {NL} || '**Post text**' || {NL} || {NL} || '#talk' || CASE WHEN rank % 2 = 1 THEN {NL} || {NL} || '**Why this one:** its opening' ELSE '' END || {NL} || {NL} || '**What is said:** ' || caption, {NL} ORDER BY rank) || {NL} AS sheet FROM timed GROUP BY rec_id""")
def review_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet that goes out with the clips of each conversation."""
    return sinks.review_sheets(*_sheet_clips(spark, sf_dir))


@query(f"""WITH RECURSIVE {SHEET} SELECT rec_id, '### ' || count(*) || CASE WHEN count(*) = 1 THEN ' clip ready' ELSE ' clips ready' END || {NL} || {NL} || 'Picked by the built-in fallback picker. [All files and the contact sheet](https://example.org/r/' || rec_id || ')' || {NL} || CASE WHEN rec_id % 3 = 0 THEN {NL} || '> **Note:** A note.' || {NL} ELSE '' END
|| {NL} || '| # | Headline | Length | Starts at | File |' || {NL} || '|---|---|---|---|---|' || {NL} || string_agg('| ' || rank || ' | ' || replace(title, '|', '\\|') || CASE WHEN rank = 1 THEN ' \\| first' ELSE '' END || ' | ' || {clock('"end" - start')} || ' | ' || CASE WHEN rank % 2 = 0 THEN '[' || {clock("start")} || '](https://example.org/at/' || rank || ')' ELSE {clock("start")} END
|| printf(' | [%02d-clip.mp4](https://example.org/d/', rank) || rec_id || printf('/%02d-clip.mp4) |', rank), {NL} ORDER BY rank) || {NL} || {NL} || '<details><summary>Post text and reasons</summary>' || {NL} || {NL}
|| string_agg('**' || rank || '. ' || title || CASE WHEN rank = 1 THEN ' | first' ELSE '' END || '**' || {NL} || {NL} || '#talk' || {NL} || CASE WHEN rank % 2 = 1 THEN {NL} || '_Why:_ its opening' || {NL} ELSE '' END, {NL} ORDER BY rank) || {NL} || '</details>' || {NL} AS comment FROM timed GROUP BY rec_id""")
def comment_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment under each conversation's request."""
    return sinks.comment_tables(*_sheet_clips(spark, sf_dir))


@query(f"""WITH {TURN_WORDS}, p AS (SELECT rec_id, string_agg('"' || word_idx || '":' || CAST(round(0.25 + (word_idx % 7) * 0.125, 2) AS DOUBLE), ',' ORDER BY word_idx) AS p FROM turn_words WHERE word_idx % 10 = 0 GROUP BY rec_id)
SELECT rec_id, '{{"version":1,"language":"en","duration":' || round(CAST(max("end") AS DOUBLE), 3) || ',"model":"small \\"x\\"","pauses":{{' || any_value(p.p) || '}},"parts":[],"words":[' || string_agg('[' || CAST(to_json(text) AS VARCHAR) || ',' || round(CAST(start AS DOUBLE), 3) || ',' || round(CAST("end" AS DOUBLE), 3) || ']', ',' ORDER BY word_idx) || ']}}' AS json FROM turn_words JOIN p USING (rec_id) GROUP BY rec_id""")
def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a transcript file."""
    w = turn_words(spark, sf_dir)
    pauses = w.where("word_idx % 10 = 0").select("rec_id", "word_idx", (0.25 + (F.col("word_idx") % 7) * 0.125).alias("length"))
    facts = w.groupBy("rec_id").agg(F.max("end").alias("duration")).select("rec_id", F.lit("en").alias("language"), "duration", F.lit('small "x"').alias("model"))
    return sinks.transcript_json(w, pauses, facts)


@query("""SELECT p_brand AS feed, left(sha1('g' || p_partkey), 16) AS key, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 28 DESC, left(sha1('g' || p_partkey), 16)) AS INTEGER) AS rank FROM part WHERE p_partkey % 5 <> 4 AND p_partkey % 28 BETWEEN 13 AND 28 QUALIFY rank <= 2""")
def fresh_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest items of each feed that are at most a week old; those without a date are none."""
    k = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("feed"), F.left(F.sha1(F.concat(F.lit("g"), k.cast("string")).cast("binary")), F.lit(16)).alias("key"), F.when(k % 5 != 4, 946684800 + (k % 28) * 86400).alias("published"))
    return Q.fresh(items, F.lit(946684800 + 20 * 86400)).select("feed", "key", "rank")


@query(r"""WITH o AS (SELECT o_orderkey AS k, o_orderkey // 2 AS half, 'v' || o_orderkey AS name, CAST(o_totalprice AS DOUBLE) / 37 AS length FROM orders WHERE o_orderkey % 3 <> 0),
listed AS (SELECT k AS ord, name AS id, k % 7 = 0 AS live, length, CASE WHEN k % 4 = 0 THEN '' ELSE 'L' || k END AS title FROM o),
told AS (SELECT name AS id, 'twitch-' || half AS key, k % 11 = 0 AS live, CASE WHEN k % 4 = 1 THEN 0.0 ELSE length + 60 END AS length, CASE WHEN k % 8 <> 5 THEN 1000000 - (k % 9) * 86400.0 END AS started, CASE WHEN k % 6 = 1 THEN 'R' || k ELSE '' END AS title FROM o),
bodies AS (SELECT CASE WHEN k % 5 = 0 THEN '<!-- stream-item:twitch-' || name || ' -->' WHEN half % 13 = 0 THEN 'x stream-item:twitch-' || half || ' y' END AS body FROM o UNION ALL SELECT 'stream-item:twitch-' || half FROM o WHERE k % 5 = 0 AND half % 13 = 0),
filed AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(body, ''), 'stream-item:([\w-]+)', 1)) AS key FROM bodies),
new AS (SELECT l.ord, l.id, t.key, t.started, coalesce(nullif(t.length, 0), l.length) AS d, coalesce(nullif(t.title, ''), nullif(l.title, ''), 'Stream') AS title FROM listed l JOIN told t ON t.id = l.id
  WHERE NOT l.live AND NOT t.live AND 'twitch-' || left(regexp_replace(l.id, '[^A-Za-z0-9]', '', 'g'), 40) NOT IN (SELECT key FROM filed) AND t.key NOT IN (SELECT key FROM filed))
SELECT key, arg_min(id, ord) AS id, arg_min(title, ord) AS title, round(arg_min(d, ord), 4) AS duration FROM new WHERE NOT (d > 0 AND d < 1800) AND NOT coalesce(started > 0 AND 1000000 - started - d > 345600, false) GROUP BY key""")
def unfiled_broadcasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broadcasts that no request carries, neither under the listing's id nor under the key it turns out to have."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    platform, name, key = F.lit("twitch").alias("platform"), F.concat(F.lit("v"), k.cast("string")), F.concat(F.lit("twitch-"), F.floor(k / 2).cast("string"))
    length = F.col("o_totalprice") / 37
    listed = o.select(k.alias("ord"), platform, name.alias("id"), (k % 7 == 0).alias("live"), length.alias("duration"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("L"), k.cast("string"))).alias("title"))
    read = o.select(platform, name.alias("id"), key.alias("key"), (k % 11 == 0).alias("live"), F.when(k % 4 == 1, 0.0).otherwise(length + 60).alias("duration"), F.when(k % 8 != 5, 1000000 - (k % 9) * 86400.0).alias("started"), F.when(k % 6 == 1, F.concat(F.lit("R"), k.cast("string"))).otherwise("").alias("title"))
    filed = o.select(F.when(k % 5 == 0, F.concat(F.lit("<!-- stream-item:twitch-"), name, F.lit(" -->"))).when(F.floor(k / 2) % 13 == 0, F.concat(F.lit("x stream-item:"), key, F.lit(" y"))).alias("body"))
    filed = filed.unionByName(o.where((k % 5 == 0) & (F.floor(k / 2) % 13 == 0)).select(F.concat(F.lit("stream-item:"), key).alias("body")))
    return Q.unfiled_broadcasts(listed, read, filed, F.lit(1000000.0), 30).select("key", "id", "title", r4("duration").alias("duration"))


@query("""WITH b AS (SELECT o_custkey AS channel, o_orderkey AS id, o_orderstatus = 'P' AS live, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'named' END AS client FROM orders), clients AS (SELECT * FROM (VALUES ('acme', true), ('_template', false)) t(client, is_real)),
only_ AS (SELECT CASE WHEN count(*) = 1 THEN any_value(client) END AS client FROM clients WHERE is_real)
SELECT channel, id, coalesce(nullif(client, ''), (SELECT client FROM only_)) AS client FROM b WHERE NOT live QUALIFY row_number() OVER (PARTITION BY channel ORDER BY id) = 1""")
def latest_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finished order of each customer as a channel's broadcast, with the client it is for."""
    o = table(spark, sf_dir, "orders")
    b = o.select(F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("live"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise("named").alias("client"))
    clients = spark.createDataFrame([("acme", True), ("_template", False)], "client string, real boolean")
    return Q.with_client(Q.latest_finished(b), clients).select("channel", "id", "client")


@query("""WITH texts AS (SELECT p_partkey AS list_id, CASE p_partkey % 7 WHEN 0 THEN ['#EXTM3U', '#EXT-X-KEY:METHOD=NONE', '#EXTINF:4,', 'a.ts'] WHEN 1 THEN ['<html>', '#EXTINF:4,', 'a.ts'] WHEN 2 THEN ['#EXTM3U', '#EXT-X-KEY:METHOD=AES-128,URI="k"', '#EXTINF:4,', 'a.ts']
  WHEN 3 THEN ['#EXTM3U', '#EXT-X-BYTERANGE:10@0', '#EXTINF:4,', 'a.ts'] WHEN 4 THEN ['#EXTM3U', '#EXT-X-ENDLIST'] WHEN 5 THEN ['#EXTM3U', '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",URI="b.m3u8"', '#EXT-X-STREAM-INF:BANDWIDTH=1', 'a.m3u8'] ELSE ['', '#EXTM3U', '#EXTINF:4,', 'a.ts'] END AS lines FROM part),
lines AS (SELECT list_id, trim(unnest(lines)) AS line, generate_subscripts(lines, 1) AS k FROM texts),
facts AS (SELECT list_id, arg_min(line, k) AS head, bool_or(starts_with(line, '#EXTINF')) AS timed, bool_or(starts_with(line, '#EXT-X-STREAM-INF:')) AS levels, bool_or(NOT starts_with(line, '#')) AS links, bool_or(starts_with(line, '#EXT-X-KEY:') AND regexp_extract(line, 'METHOD=([^,]*)', 1) NOT IN ('', 'NONE')) AS locked,
  bool_or(starts_with(line, '#EXT-X-BYTERANGE')) AS ranges, bool_or(starts_with(line, '#EXT-X-MEDIA:') AND regexp_extract(line, 'URI="([^"]*)"', 1) <> '') AS apart FROM lines WHERE line <> '' GROUP BY list_id),
found AS (SELECT list_id, CASE WHEN list_id % 7 = 5 THEN NULL WHEN NOT starts_with(head, '#EXTM3U') THEN 'no playlist' WHEN locked THEN 'encrypted' WHEN ranges THEN 'byte ranges' WHEN NOT (timed AND links) THEN 'empty' END AS media,
  CASE WHEN NOT starts_with(head, '#EXTM3U') THEN 'no playlist' WHEN timed THEN NULL WHEN apart THEN 'sound apart' WHEN NOT (levels AND links) THEN 'empty' END AS master FROM facts)
SELECT * FROM found WHERE media IS NOT NULL OR master IS NOT NULL""")
def playlist_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why playlists cannot be used, as media and as master playlists."""
    k = F.col("p_partkey")
    piece, level = ["#EXTINF:4,", "a.ts"], ["#EXT-X-STREAM-INF:BANDWIDTH=1", "a.m3u8"]
    kinds = [["#EXTM3U", '#EXT-X-KEY:METHOD=NONE', *piece], ["<html>", *piece], ["#EXTM3U", '#EXT-X-KEY:METHOD=AES-128,URI="k"', *piece], ["#EXTM3U", "#EXT-X-BYTERANGE:10@0", *piece], ["#EXTM3U", "#EXT-X-ENDLIST"], ["#EXTM3U", '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",URI="b.m3u8"', *level], ["", "#EXTM3U", *piece]]
    texts = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in kinds]), (k % 7).cast("int") + 1)
    lines = table(spark, sf_dir, "part").select(k.alias("list_id"), F.posexplode(texts).alias("line_no", "line"))
    # what is a master playlist is no media playlist without pieces: list 5 has levels only
    media = H.faults(lines.where("list_id % 7 <> 5")).withColumnRenamed("fault", "media")
    return media.join(H.faults(lines, master=True).withColumnRenamed("fault", "master"), "list_id", "full").select("list_id", "media", "master")


@query("""SELECT p_partkey AS rec_id, 'mov' AS format, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_size + 0.5 END AS duration, p_partkey % 3 <> 0 AS has_audio, p_partkey % 5 <> 0 AS has_video, p_partkey % 2 = 0 AS has_cover,
CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 480 ELSE CASE WHEN p_partkey % 2 = 0 THEN CAST(round_even((640 + p_size) * (16.0 / 15) / 2, 0) AS INTEGER) * 2 ELSE CAST(round_even((640 + p_size) / 2, 0) AS INTEGER) * 2 END END AS width,
CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN CAST(round_even((640 + p_size) * (16.0 / 15) / 2, 0) AS INTEGER) * 2 ELSE CAST(round_even((640 + p_size) / 2, 0) AS INTEGER) * 2 END ELSE 480 END AS height,
round(CASE WHEN p_partkey % 5 = 0 THEN 0.0 WHEN p_partkey % 7 = 0 THEN 25.0 ELSE 30000.0 / 1001 END, 4) AS fps FROM part""")
def probe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, rates and streams from descriptions of media files."""
    k, size = F.col("p_partkey"), F.col("p_size")
    ratio = F.when(k % 2 == 0, '"sample_aspect_ratio": "16:15", ').when(k % 4 == 1, '"sample_aspect_ratio": "0:1", ').otherwise("")
    turn = F.when(k % 3 == 1, F.when(k % 2 == 0, '"side_data_list": [{"x": 1}, {"rotation": -90}], ').otherwise('"tags": {"rotate": "270"}, ')).otherwise("")
    rate = F.when(k % 7 == 0, '"avg_frame_rate": "0/0", "r_frame_rate": "25/1"').otherwise('"avg_frame_rate": "30000/1001", "r_frame_rate": "30/1"')
    video = F.concat(F.lit(', {"codec_type": "video", "width": '), (640 + size).cast("string"), F.lit(', "height": 480, '), ratio, turn, rate, F.lit("}"))
    audio = F.when(k % 3 != 0, ', {"codec_type": "audio"}').otherwise("")
    cover = F.when(k % 2 == 0, ', {"codec_type": "video", "width": 600, "height": 600, "disposition": {"attached_pic": 1}}').otherwise("")
    length = F.when(k % 4 == 0, '"N/A"').otherwise(F.concat(F.lit('"'), (size + 0.5).cast("string"), F.lit('"')))
    text = F.concat(F.lit('{"format": {"format_name": "mov", "duration": '), length, F.lit('}, "streams": [{"codec_type": "data"}'), audio, cover, F.when(k % 5 != 0, video).otherwise(', {"codec_type": "video", "width": 8, "height": 8}'), F.lit("]}"))
    return R.probe_facts(table(spark, sf_dir, "part").select(k.alias("rec_id"), text.alias("probe"))).withColumn("fps", r4("fps"))


@query("""SELECT p_partkey AS id, CASE WHEN NOT (p_partkey % 7 = 0) AND (p_container_ SIMILAR TO '.*(mp4|mov|matroska|webm|wav|flac|ogg).*') THEN NULL WHEN p_partkey % 3 = 0 THEN 'mkv' ELSE 'mka' END AS rewrapped, CASE WHEN NOT (p_partkey % 7 = 0) AND (p_container_ SIMILAR TO '.*(mp4|mov|matroska|webm|wav|flac|ogg).*') THEN '' WHEN p_partkey % 3 = 0 THEN '0:a:0 0:V:0' ELSE '0:a:0' END AS maps
FROM (SELECT p_partkey, ['mov,mp4,m4a', 'mp3', 'mpegts', 'matroska,webm', 'aac', 'wav', '', 'flac', 'ogg'][p_partkey % 9 + 1] AS p_container_ FROM part)""")
def rewraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are put into a container that can be cut anywhere, and what of them."""
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ["mov,mp4,m4a", "mp3", "mpegts", "matroska,webm", "aac", "wav", "", "flac", "ogg"]))
    x = table(spark, sf_dir, "part").select(k.alias("id"), F.element_at(kinds, (k % 9 + 1).cast("int")).alias("format"), (k % 3 == 0).alias("has_video"), (k % 7 == 0).alias("forced"))
    return R.rewraps(x).select("id", "rewrapped", F.array_join("maps", " ").alias("maps"))


@query("""WITH files AS (SELECT o_orderkey AS id, o_orderkey % 6 <> 0 AS sound, o_totalprice AS d, CASE WHEN o_orderkey % 4 = 1 THEN 9 * CAST(1073741824 AS BIGINT) ELSE 1 END AS bytes, CASE WHEN o_orderkey % 5 <> 0 THEN 10.0 + (o_orderkey % 3) * 0.04 END AS v, 10.0 + (o_orderkey % 4) * 0.029 AS a, 10.0 AS expected FROM orders)
SELECT id, CASE WHEN NOT sound THEN 'no sound' WHEN d < 30 THEN 'too short' WHEN d > 8 * 3600 THEN 'too long' WHEN bytes > 8 * CAST(1073741824 AS BIGINT) THEN 'too large' END AS media, CASE WHEN v IS NULL OR a IS NULL THEN 'missing' WHEN abs(v - a) > 0.05 OR abs(v - expected) > 0.05 THEN 'lengths' END AS render FROM files""")
def media_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no episodes, and clips whose picture and sound are unlike."""
    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 6 != 0).alias("has_audio"), F.col("o_totalprice").alias("duration"), F.when(k % 4 == 1, 9 << 30).otherwise(1).alias("bytes"), F.when(k % 5 != 0, 10.0 + (k % 3) * 0.04).alias("video"), (10.0 + (k % 4) * 0.029).alias("audio"), F.lit(10.0).alias("expected"))
    return R.render_faults(R.usable_media(x).withColumnRenamed("fault", "media")).select("id", "media", F.col("fault").alias("render"))


@query(r"""WITH typed AS (SELECT c_custkey AS id, lower(c_mktsegment) AS s, CASE c_custkey % 5 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN '@' || upper(c_mktsegment) WHEN 2 THEN 'https://www.twitch.tv/' || lower(c_mktsegment) WHEN 3 THEN '  ' ELSE 'not a channel!' END AS name,
  CASE c_custkey % 4 WHEN 0 THEN 'https://www.dropbox.com/s/' || c_custkey || '?dl=0' WHEN 1 THEN 'https://www.dropbox.com/s/' || c_custkey || '?a=b' WHEN 2 THEN 'https://www.dropbox.com/s/' || c_custkey ELSE 'https://example.org/?dl=0' END AS share,
  CASE c_custkey % 3 WHEN 0 THEN 'https://drive.google.com/file/d/abcdefghij' || c_custkey || '/view' WHEN 1 THEN 'https://drive.google.com/open?id=xyz' || c_custkey || '&b=1' ELSE 'https://example.org/d/abcdefghijk' END AS file,
  CASE c_custkey % 4 WHEN 0 THEN CAST(1700000000 + c_custkey AS VARCHAR) WHEN 1 THEN '2024-01-01' WHEN 2 THEN '2024-01-01 01:00:00+00:00' ELSE 'soon' END AS moment FROM customer),
p AS (SELECT *, trim(name) AS v, regexp_extract(name, '^https?://([^/]*)', 1) AS host, regexp_extract(share, '^https?://([^/]*)', 1) AS share_host, regexp_replace(share, '([?&])dl=[0-9]', '\1dl=1') AS asked, ltrim(regexp_replace(trim(name), '^https://www\.twitch\.tv/', ''), '@') AS bare FROM typed)
SELECT id, CASE WHEN v = '' THEN '' WHEN regexp_full_match(bare, '[A-Za-z0-9_]+') THEN lower(bare) END AS channel, CASE WHEN host = '' THEN 'https://kick.com/' ELSE 'https://www.twitch.tv/' END || s AS url, 'twitch-' || left(regexp_replace(s || '-' || id, '[^A-Za-z0-9]', '', 'g'), 40) AS key,
CASE WHEN share_host NOT LIKE '%dropbox.com' THEN share WHEN regexp_matches(asked, '[?&]dl=1') THEN asked WHEN contains(asked, '?') THEN asked || '&dl=1' ELSE asked || '?dl=1' END AS link,
CASE WHEN file NOT LIKE 'https://drive.google.com/%' THEN '' WHEN regexp_matches(file, '/d/[A-Za-z0-9_-]{10,}') THEN regexp_extract(file, '/d/([A-Za-z0-9_-]{10,})', 1) ELSE regexp_extract(file, '[?&]id=([^&#]*)', 1) END AS drive,
host LIKE '%twitch.tv' OR id % 2 = 0 AS long, CASE WHEN TRY_CAST(moment AS DOUBLE) > 0 THEN TRY_CAST(moment AS DOUBLE) ELSE epoch(TRY_CAST(moment AS TIMESTAMPTZ)) END AS started FROM p""")
def link_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels, keys, download links, file ids and times from what people type."""
    k, s = F.col("c_custkey"), F.lower("c_mktsegment")
    name = k.cast("string")
    typed = F.when(k % 5 == 0, s).when(k % 5 == 1, F.concat(F.lit("@"), F.upper(s))).when(k % 5 == 2, F.concat(F.lit("https://www.twitch.tv/"), s)).when(k % 5 == 3, "  ").otherwise("not a channel!")
    share = F.when(k % 4 == 0, F.concat(F.lit("https://www.dropbox.com/s/"), name, F.lit("?dl=0"))).when(k % 4 == 1, F.concat(F.lit("https://www.dropbox.com/s/"), name, F.lit("?a=b"))).when(k % 4 == 2, F.concat(F.lit("https://www.dropbox.com/s/"), name)).otherwise("https://example.org/?dl=0")
    drive = F.when(k % 3 == 0, F.concat(F.lit("https://drive.google.com/file/d/abcdefghij"), name, F.lit("/view"))).when(k % 3 == 1, F.concat(F.lit("https://drive.google.com/open?id=xyz"), name, F.lit("&b=1"))).otherwise("https://example.org/d/abcdefghijk")
    when = F.when(k % 4 == 0, (1700000000 + k).cast("string")).when(k % 4 == 1, "2024-01-01").when(k % 4 == 2, "2024-01-01 01:00:00+00:00").otherwise("soon")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), K.channel_name(typed, "twitch").alias("channel"), K.channel_url(F.when(k % 5 == 2, "twitch").otherwise("kick"), s).alias("url"), K.broadcast_key(F.lit("twitch"), F.concat(s, F.lit("-"), name)).alias("key"), K.normalize(share).alias("link"), K.drive_id(drive).alias("drive"),
        K.is_long(typed, F.when(k % 2 == 0, "stream")).alias("long"), K.timestamp_of(when).alias("started"),
    )


@query("""WITH raised AS (SELECT o_orderkey AS id, o_custkey AS client, 'notice:' || o_orderkey || '.' AS text FROM orders), open_ AS (SELECT o_custkey AS client, 'so notice:' || o_orderkey || '. it is' AS body FROM orders WHERE o_orderkey % 4 = 1 AND o_orderstatus <> 'F')
SELECT r.id FROM raised r WHERE NOT EXISTS (SELECT 1 FROM open_ o WHERE o.client = r.client AND contains(o.body, r.text))""")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that no open request of their client mentions yet."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    raised = o.select(k.alias("notice_id"), F.col("o_custkey").alias("client"), F.concat(F.lit("notice:"), k.cast("string"), F.lit(".")).alias("text"))
    issues = o.where("o_orderkey % 4 = 1").select(F.col("o_custkey").alias("client"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), F.concat(F.lit("so notice:"), k.cast("string"), F.lit(". it is")).alias("body"))
    return Q.unnoticed(raised, issues).select(F.col("notice_id").alias("id"))


@query("""WITH chosen AS (SELECT c_custkey AS id, 2 AS first FROM customer WHERE c_custkey % 4 = 0), failed AS (SELECT c_custkey AS id, 'timed out' AS error FROM customer WHERE c_custkey % 4 = 1), asked AS (SELECT c_custkey AS id, c_custkey % 4 <> 3 AS asked FROM customer),
known AS (SELECT a.id, a.asked, f.error, c.first FROM asked a LEFT JOIN failed f USING (id) LEFT JOIN chosen c USING (id))
SELECT id AS rec_id, CASE WHEN first IS NULL THEN 'heuristic' ELSE 'model' END AS picker, CASE WHEN first IS NOT NULL THEN '' WHEN error IS NOT NULL THEN 'The model was not reachable (' || left(error, 200) || '), so the built-in fallback picked instead.' WHEN asked THEN 'The model returned no usable clips, so the built-in fallback picked instead.' ELSE 'No credential is set, so the built-in fallback picked these.' END AS note, coalesce(first, 1) AS first FROM known""")
def picks_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's picks where it gave any, else those of the fallback, and why."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("rec_id"), k)
    chosen = c.where(k % 4 == 0).select("rec_id", F.lit(2).alias("first"))
    picks, notes = C.with_fallback(chosen, c.select("rec_id", F.lit(1).alias("first")), c.select("rec_id", (k % 4 != 3).alias("asked")), c.where(k % 4 == 1).select("rec_id", F.lit("timed out").alias("error")))
    return picks.join(notes, "rec_id").select("rec_id", "picker", "note", "first")


@query("""WITH t AS (SELECT conv_id AS rec_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT rec_id, idx, start, "end" FROM turn_lines) SELECT a.rec_id, CAST(0 AS INTEGER) AS pos, round(a.start, 4) AS start, round(least(b."end", a.start + 300), 4) AS "end", CASE WHEN a.idx % 3 = 0 THEN 50.0 WHEN a.idx % 3 = 1 THEN 100.0 ELSE 7.5 END AS score, 'because' AS why FROM l a JOIN l b ON b.rec_id = a.rec_id AND b.idx = a.idx + 2 WHERE a.idx % 4 <> 3""".replace("WITH t AS", f"WITH {TURN_LINES}, t AS"))
def reply_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches that replies name by their lines; those beyond the last line or with a score that is no number go."""
    lines = turn_lines(spark, sf_dir)
    score = F.when(F.col("idx") % 4 == 3, ', "score": "x"').when(F.col("idx") % 3 == 0, "").when(F.col("idx") % 3 == 1, ', "score": 250').otherwise(', "score": "7.5"')
    reply = F.concat(F.format_string('{"windows": [{"first": %d, "last": %d', "idx", F.col("idx") + 2), score, F.lit(', "reason": " because "}]}'))
    return R.reply_windows(lines.select("rec_id", reply.alias("reply")), lines).select("rec_id", "pos", r4("start").alias("start"), r4("end").alias("end"), "score", "why")
