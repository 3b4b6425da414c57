"""Links, playlists, replies, requests, feeds and channels, from pages, parts, orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import links as K
from tempora.functions import text as T
from tempora.operators import select as P
from tempora.operators import signal as L
from tempora.operators import work_queue as Q
from tempora.plans.adapters import quoted, r4, registry, table
from tempora.sources import playlists as H
from tempora.sources import readers as R

QUERIES, ORACLE_SQL, query = registry()


@query(r"""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS redacted, coalesce(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^https?://([^/?#]*)', 1)), '^.*@', ''), ':.*$', ''), '') AS host,
CASE WHEN lower(regexp_extract(regexp_extract(trim(url), '^https?://[^/?#]*([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) IN (""" + quoted(K.MEDIA_ENDINGS) + r""") THEN lower(regexp_extract(regexp_extract(trim(url), '^https?://[^/?#]*([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) ELSE 'mp4' END AS ending FROM pages WHERE url IS NOT NULL""")
def link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, media ending and redacted form of every page's link."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    return p.select("page_id", K.redact("url").alias("redacted"), F.coalesce(K.host_of("url"), F.lit("")).alias("host"), K.file_ending("url").alias("ending"))


LINKS = """links AS (SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'https://www.twitch.tv/videos/' || c_custkey WHEN 1 THEN 'https://twitch.tv/' || lower(c_mktsegment) WHEN 2 THEN 'https://kick.com/' || lower(c_mktsegment)
  WHEN 3 THEN 'https://twitch.tv/directory' WHEN 4 THEN 'https://kick.com/x/videos/0123abcd-0000-4000-8000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') WHEN 5 THEN 'https://cdn.example.org/' || c_custkey || '/live.m3u8?t=1' ELSE 'not a link' END AS url FROM customer)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, segment = F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    url = (
        F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("https://www.twitch.tv/videos/"), k))
        .when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("https://twitch.tv/"), segment))
        .when(F.col("c_custkey") % 7 == 2, F.concat(F.lit("https://kick.com/"), segment))
        .when(F.col("c_custkey") % 7 == 3, "https://twitch.tv/directory")
        .when(F.col("c_custkey") % 7 == 4, F.concat(F.lit("https://kick.com/x/videos/0123abcd-0000-4000-8000-"), F.lpad(k, 12, "0")))
        .when(F.col("c_custkey") % 7 == 5, F.concat(F.lit("https://cdn.example.org/"), k, F.lit("/live.m3u8?t=1")))
        .otherwise("not a link")
    )
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), url.alias("url"))


@query(f"""WITH {LINKS} SELECT id, CASE id % 7 WHEN 0 THEN 'twitch' WHEN 1 THEN 'twitch' WHEN 2 THEN 'kick' WHEN 4 THEN 'kick' WHEN 5 THEN 'hls' END AS platform, CASE id % 7 WHEN 0 THEN 'vod' WHEN 1 THEN 'channel' WHEN 2 THEN 'channel' WHEN 4 THEN 'vod' WHEN 5 THEN 'playlist' END AS kind,
CASE id % 7 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN regexp_extract(url, '[^/]+$', 0) WHEN 2 THEN regexp_extract(url, '[^/]+$', 0) WHEN 4 THEN regexp_extract(url, '[^/]+$', 0) WHEN 5 THEN left(sha1(url), 12) END AS key FROM links""")
def link_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of stream each link points to."""
    return _links(spark, sf_dir).select("id", K.classify("url").alias("c")).select("id", "c.platform", "c.kind", "c.key")


@query(f"""WITH {LINKS} SELECT id, 'https://www.twitch.tv/videos/' || id || printf('?t=%dh%dm%ds', id * 37 // 3600, id * 37 % 3600 // 60, id * 37 % 60) AS moment FROM links WHERE id % 7 = 0""")
def moment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links into past broadcasts at a moment."""
    x = _links(spark, sf_dir).withColumn("kind", K.classify("url"))
    return x.select("id", K.moment_url(F.col("kind"), F.col("id") * 37).alias("moment")).where("moment <> ''")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(trunc(o_totalprice) AS BIGINT) WHEN 1 THEN o_orderkey ELSE 0 END AS whole, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN CAST(o_orderkey AS DOUBLE) ELSE 0.0 END AS number FROM orders""")
def tolerant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from text, 0 for anything else."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.col("o_totalprice").cast("string")).when(k % 4 == 1, k.cast("string")).when(k % 4 == 2, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), K.to_int(text).alias("whole"), K.to_float(text).alias("number"))


# One playlist for each brand: parts in order of their keys; a break before each whose size is 50.
PIECES = """p AS (SELECT p_brand AS list_id, p_partkey, p_size, 2.0 + p_size / 10.0 AS dur, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS seq FROM part),
pieces AS MATERIALIZED (SELECT list_id, seq, 'https://cdn.example.org/live/' || p_partkey || '.ts' AS url, round(coalesce(sum(dur) OVER (PARTITION BY list_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 4) AS start, dur AS duration,
  CAST(sum(CASE WHEN p_size = 50 AND seq > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY list_id ORDER BY seq) AS INTEGER) AS run FROM p)"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    head = F.when(F.col("p_size") == 50, F.array(F.lit("#EXT-X-DISCONTINUITY"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(head, F.array(F.format_string("#EXTINF:%.1f,", 2.0 + F.col("p_size") / 10.0), F.concat(F.col("p_partkey").cast("string"), F.lit(".ts"))))
    rows = p.select(F.col("p_brand").alias("list_id"), "p_partkey", F.posexplode(lines).alias("i", "line"))
    return H.media_pieces(rows.select("list_id", (F.col("p_partkey") * 10 + F.col("i")).alias("line_no"), "line", F.lit("https://cdn.example.org/live/index.m3u8").alias("base")))


@query(f"""WITH {PIECES} SELECT list_id, CAST(seq AS INTEGER) AS seq, url, start, duration, run FROM pieces""")
def hls_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of media playlists with their clock and their run."""
    return _pieces(spark, sf_dir).select("list_id", "seq", "url", r4("start").alias("start"), "duration", "run")


@query(f"""WITH {PIECES} SELECT list_id, run, min(start) AS start, round(max(start + duration), 4) AS "end" FROM pieces GROUP BY list_id, run""")
def hls_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uninterrupted stretches of media playlists."""
    return H.runs(_pieces(spark, sf_dir)).select("list_id", "run", r4("start").alias("start"), r4("end").alias("end"))


@query(f"""WITH {PIECES} SELECT list_id, run, string_agg(url, ' ' ORDER BY seq) AS urls FROM pieces WHERE start < 120.05 AND start + duration > 60.05 GROUP BY list_id, run""")
def hls_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces between a minute and two minutes, by run."""
    p = _pieces(spark, sf_dir)
    spans = p.select("list_id").distinct().select("list_id", F.lit(0).alias("span_id"), F.lit(60.05).alias("a"), F.lit(120.05).alias("b"))
    return H.between(p, spans).select("list_id", "run", F.array_join("urls", " ").alias("urls"))


# One master playlist for each brand: a level for each part.
LEVELS = """v AS (SELECT p_brand AS list_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS level, p_size * 100000 + p_partkey AS bandwidth, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 90 * (1 + p_size % 16) END AS height,
  CASE p_partkey % 11 WHEN 0 THEN 'mp4a.40.2' WHEN 1 THEN 'hvc1.1,mp4a.40.2' WHEN 2 THEN 'av01.0' ELSE 'avc1.64,mp4a.40.2' END AS codecs FROM part),
k AS (SELECT *, height = 0 AS audio, CASE WHEN codecs LIKE 'avc1%' THEN 0 WHEN codecs LIKE 'hvc1%' THEN 2 ELSE 3 END AS r FROM v)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    codecs = F.when(k % 11 == 0, "mp4a.40.2").when(k % 11 == 1, "hvc1.1,mp4a.40.2").when(k % 11 == 2, "av01.0").otherwise("avc1.64,mp4a.40.2")
    height = 90 * (1 + size % 16)
    shape = F.when(k % 11 == 0, "").otherwise(F.format_string(",RESOLUTION=%dx%d", (height * 16 / 9).cast("int"), height))
    info = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), (size * 100000 + k).cast("string"), shape, F.lit(',CODECS="'), codecs, F.lit('"'))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("list_id"), k.alias("k"), F.posexplode(F.array(info, F.concat(F.lit("v"), k.cast("string"), F.lit(".m3u8")))).alias("i", "line"))
    return H.master_levels(rows.select("list_id", (F.col("k") * 10 + F.col("i")).alias("line_no"), "line", F.lit("https://cdn.example.org/live/master.m3u8").alias("base")))


@query(f"""WITH {LEVELS} SELECT list_id, CAST(level AS INTEGER) AS level, bandwidth, CAST(height AS BIGINT) AS height, codecs FROM v""")
def hls_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality levels of master playlists."""
    return _levels(spark, sf_dir).select("list_id", "level", "bandwidth", "height", "codecs")


@query(f"""WITH {LEVELS}, scan AS (SELECT list_id, level FROM k QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY NOT audio, bandwidth, height, level) = 1),
best AS (SELECT list_id, level FROM k WHERE NOT audio QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY height > 1080, CASE WHEN height > 1080 THEN height ELSE -height END, r, bandwidth DESC, level) = 1)
SELECT s.list_id, CAST(s.level AS INTEGER) AS scan, CAST(b.level AS INTEGER) AS best FROM scan s LEFT JOIN best b USING (list_id)""")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest level with the sound, and the sharpest picture up to 1080 lines."""
    return H.chosen_levels(_levels(spark, sf_dir)).select("list_id", "scan", "best")


@query("""SELECT p_partkey AS reply_id, CAST(0 AS INTEGER) AS pos, CAST(p_size AS INTEGER) AS first, CAST(p_size + 3 AS INTEGER) AS last, p_name AS title, 'Cap: ' || p_name AS caption, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '#ab #x' END AS tags, 'two lines' AS why,
CASE p_partkey % 5 WHEN 2 THEN least(100.0, p_retailprice) WHEN 3 THEN 0.0 WHEN 4 THEN 70.5 ELSE 50.0 END AS score FROM part WHERE p_partkey % 7 NOT IN (4, 5) AND p_partkey % 4 <> 3""")
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of replies that are plain, fenced, objects, surrounded by talk or broken.

    A list of one object inside talk is read as that object, which holds no clips, before it is read as a list.
    """
    k, size = F.col("p_partkey"), F.col("p_size")
    first = F.when(k % 4 == 0, size.cast("string")).when(k % 4 == 1, F.concat(F.lit('"'), size.cast("string"), F.lit('"'))).when(k % 4 == 2, F.concat(size.cast("string"), F.lit(".7"))).otherwise(F.lit('"2.5"'))
    score = F.when(k % 5 == 1, '"score": "high", ').when(k % 5 == 2, F.concat(F.lit('"score": '), F.col("p_retailprice").cast("string"), F.lit(", "))).when(k % 5 == 3, '"score": -5, ').when(k % 5 == 4, '"score": "70.5", ').otherwise("")
    tags = F.when(k % 3 == 0, '"none"').otherwise('["#A b", "x", "X"]')
    item = F.concat(F.lit('{"first": '), first, F.format_string(', "last": "%d", "title": "  %s ", "caption": "Cap:\\n%s", ', size + 3, "p_name", "p_name"), score, F.lit('"hashtags": '), tags, F.lit(', "why": "two\\n lines"}'))
    both = F.concat(F.lit("["), item, F.lit(', "junk"]'))
    text = (
        F.when(k % 7 == 1, F.concat(F.lit("```json\n"), both, F.lit("\n```"))).when(k % 7 == 2, F.concat(F.lit('{"clips": '), both, F.lit("}"))).when(k % 7 == 3, F.concat(F.lit('Here: {"clips": '), both, F.lit("} ok")))
        .when(k % 7 == 4, "no list").when(k % 7 == 5, F.concat(F.lit("Here: "), both, F.lit(" Enjoy."))).when(k % 7 == 6, F.concat(F.lit("Here: ["), item, F.lit(', {"last": 1}] Enjoy.'))).otherwise(both)
    )
    found = R.valid_items(table(spark, sf_dir, "part").select(k.alias("reply_id"), text.alias("reply")))
    return found.select("reply_id", "pos", "first", "last", "title", "caption", F.array_join("hashtags", " ").alias("tags"), "why", "score")


ISSUES = """issues AS (SELECT o_orderkey AS number, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderkey % 5 = 0 AS labelled, o_orderkey % 9 = 0 AS clipped, CASE o_orderkey % 4 WHEN 0 THEN 'OWNER' WHEN 1 THEN 'MEMBER' ELSE 'NONE' END AS assoc,
  CASE WHEN o_orderkey % 6 = 0 THEN 'github-actions[bot]' ELSE 'someone' END AS login FROM orders)"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each order."""
    k = F.col("o_orderkey")
    body = F.when(k % 6 == 3, F.format_string("### Client\n\nold\n\n### Client\n\n_No response_\n\n### Episode link\n\nhttps://example.org/e/%d.mp4.\n\n### Number of clips\n\n%d\n\n### Notes\n\nclient: other\nclient: third", k, k % 40)).when(
        k % 3 == 0, F.format_string("### Client\n\nold\n\n### Client\n\nacme%d\n\n### Episode link\n\nhttps://example.org/e/%d.mp4.\n\n### Number of clips\n\n%d\n\n### Notes\n\n_No response_", F.col("o_custkey"), k, k % 40)).when(
        k % 3 == 1, F.format_string("client: Acme%d\nlink: https://example.org/e/%d.mp4\n**note:** %s\nclient: second\nnote: again", F.col("o_custkey"), k, F.col("o_orderpriority"))).otherwise(F.format_string("please look at https://example.org/e/%d.mp4, feed-item:%s", k, F.left(F.sha1(k.cast("string").cast("binary")), F.lit(16))))
    labels = F.filter(F.array(F.when(k % 5 == 0, "episode"), F.when(k % 9 == 0, "clipped"), F.lit("other")), lambda x: x.isNotNull())
    assoc = F.when(k % 4 == 0, "OWNER").when(k % 4 == 1, "MEMBER").otherwise("NONE")
    return table(spark, sf_dir, "orders").select(k.alias("number"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"), F.concat(F.lit("Episode: "), F.col("o_orderpriority")).alias("title"), body.alias("body"), labels.alias("labels"), assoc.alias("author_association"), F.when(k % 6 == 0, Q.BOT).otherwise("someone").alias("login"), F.lit(False).alias("pull_request"))


@query(f"""WITH {ISSUES} SELECT number, CASE WHEN number % 6 = 3 THEN '' ELSE 'acme' || o_custkey END AS client, 'https://example.org/e/' || number || '.mp4' AS source, 'Episode: ' || o_orderpriority AS title, CASE WHEN number % 3 = 1 THEN o_orderpriority WHEN number % 6 = 3 THEN 'client: other' || chr(10) || 'client: third' ELSE '' END AS notes,
CASE WHEN number % 3 = 0 AND number % 40 BETWEEN 1 AND 30 THEN CAST(number % 40 AS INTEGER) END AS count FROM issues WHERE number % 3 <> 2 UNION ALL
SELECT number, '', 'https://example.org/e/' || number || '.mp4', 'Episode: ' || o_orderpriority, '', NULL FROM issues WHERE number % 3 = 2""")
def issue_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client, link, title, notes and count of requests written in three ways."""
    return Q.issue_fields(_issues(spark, sf_dir))


@query(f"""WITH {ISSUES} SELECT number FROM issues WHERE o_orderstatus <> 'F' AND (labelled OR number % 3 = 0) AND NOT clipped AND (assoc <> 'NONE' OR login <> 'someone')""")
def queue_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that may be worked on."""
    return Q.eligible(_issues(spark, sf_dir)).select("number")


@query("""SELECT o_orderkey AS number, left(sha1(CAST(o_orderkey AS VARCHAR)), 16) AS key FROM orders WHERE o_orderkey % 3 <> 2""")
def queue_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that no request carries yet."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.left(F.sha1(F.col("o_orderkey").cast("string").cast("binary")), F.lit(16)).alias("key"))
    return Q.not_filed(items, _issues(spark, sf_dir)).select("number", "key")


@query(f"""WITH {ISSUES}, e AS (SELECT number FROM issues WHERE o_orderstatus <> 'F' AND (labelled OR number % 3 = 0) AND NOT clipped AND (assoc <> 'NONE' OR login <> 'someone'))
SELECT number, CAST(row_number() OVER (ORDER BY number) AS INTEGER) AS place FROM e ORDER BY number LIMIT 6""")
def queue_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six requests of a run; a request counts once."""
    e = Q.eligible(_issues(spark, sf_dir)).select("number", F.col("number").alias("ord"))
    return Q.next_run(e.unionByName(e.withColumn("ord", F.col("ord") + 7)))


@query("""SELECT o_custkey AS channel, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) <= 2""")
def newest_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest orders of each customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return P.newest(o, "channel", "o_orderdate", 2, "id").select("channel", "id", "rank")


@query("""WITH b AS (SELECT o_orderkey AS id, epoch(o_orderdate) AS started, o_totalprice / 40 AS duration, o_orderstatus = 'P' AS live FROM orders)
SELECT id FROM b WHERE NOT live AND duration >= 1800 AND 883612800 - (started + duration) <= 345600""")
def watchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished broadcasts that are long enough and ended after 28 December 1997."""
    o = table(spark, sf_dir, "orders")
    b = o.select(F.col("o_orderkey").alias("id"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("started"), (F.col("o_totalprice") / 40).alias("duration"), (F.col("o_orderstatus") == "P").alias("live"))
    return Q.watchable(b, F.lit(883612800.0), 30).select("id")


@query("""WITH c AS (SELECT l_orderkey AS rec_id, l_linenumber AS clip_id, epoch(l_shipdate) AS created, CAST(l_quantity AS BIGINT) AS views FROM lineitem), r AS (SELECT o_orderkey AS rec_id, epoch(o_orderdate) AS started FROM orders),
x AS (SELECT rec_id, clip_id, created - started - 30 AS t, views FROM c JOIN r USING (rec_id) WHERE created - started - 30 BETWEEN 0 AND 5184000)
SELECT rec_id, round(t, 1) AS "at", views FROM x QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY views DESC, clip_id) <= 3""")
def viewer_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as viewers' clips on their order's clock: the three most viewed."""
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").alias("clip_id"), sec("l_shipdate").alias("created"), F.col("l_quantity").cast("long").alias("views"), F.lit("").alias("title"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), sec("o_orderdate").alias("started"), F.lit(5184000.0).alias("duration"))
    return Q.viewer_hints(c, r, limit=3).select("rec_id", "at", "views")


@query("""SELECT o_orderkey AS id, CASE WHEN lufs > -70 AND lufs < 0 THEN greatest(-20.0, least(20.0, -14.0 - lufs)) ELSE 0.0 END AS gain FROM (SELECT o_orderkey, CAST(o_orderkey % 90 AS DOUBLE) - 80.5 AS lufs FROM orders)""")
def steady_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain to the target loudness."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 90).cast("double") - 80.5).alias("lufs"))
    return L.steady_gain(o).select("id", "gain")


@query("""SELECT p_brand AS feed, left(sha1('g' || p_partkey), 16) AS key, p_name AS title, 'https://example.org/' || p_partkey || '.mp3' AS source, 946684800 + (p_partkey % 28) * 86400 AS published FROM part WHERE p_partkey % 4 <> 3""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of feeds, one feed text per part; items without media are left out."""
    k = F.col("p_partkey")
    media = F.when(k % 4 == 3, "").otherwise(F.format_string('<enclosure url="https://example.org/%d.mp3"/>', k))
    day = F.format_string("Sat, %d Jan 2000 00:00:00 +0000", k % 28 + 1)
    xml = F.concat(F.lit("<rss><channel><item><title> "), F.col("p_name"), F.lit("</title><guid>g"), k.cast("string"), F.lit("</guid><pubDate>"), day, F.lit("</pubDate>"), media, F.lit("</item></channel></rss>"))
    items = R.feed_items(table(spark, sf_dir, "part").select(F.col("p_brand").alias("feed"), xml.alias("xml")))
    return items.select("feed", "key", "title", "source", F.unix_timestamp("published").alias("published"))


MESSAGES = ["Connection timed out", "This video is subscriber-only", "HTTP Error 403: Forbidden", "HTTP Error 404", "Something else"]


@query(f"""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'subscribers' WHEN 2 THEN 'refused' WHEN 3 THEN 'missing' ELSE 'unreadable' END AS why, '&H00' || upper(printf('%02x%02x%02x', o_orderkey % 251, o_orderkey % 241, o_orderkey % 239)) AS colour FROM orders""")
def failures_and_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of downloaders' messages, and colours as subtitles write them."""
    k = F.col("o_orderkey")
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (k % 5).cast("int") + 1)
    colour = F.concat(F.lit("#"), F.format_string("%02x%02x%02x", k % 239, k % 241, k % 251))
    return table(spark, sf_dir, "orders").select(k.alias("id"), T.explain_failure(message).alias("why"), T.ass_colour(colour).alias("colour"))
