"""Requests, feeds and channels: what may run, what is new, what runs next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import text as T

# Results depend on these lists.
TRUSTED = ["OWNER", "MEMBER", "COLLABORATOR"]
BOT = "github-actions[bot]"
EMPTY = ["", "_no response_", "none", "n/a"]
LINK = r"https?://[^\s<>\"')\]]+"
ASKS = r"(?mi)^\s*(#{2,4}\s*|\**)episode (link|file)"


def looks_like_request(body: Column) -> Column:
    return F.coalesce(body.rlike(ASKS) & body.rlike(LINK), F.lit(False))


def eligible(issues: DataFrame) -> DataFrame:
    """Open issues (number, state, labels, body, author_association, login, pull_request) that may be worked on."""
    trusted = F.col("author_association").isin(TRUSTED) | (F.col("login") == BOT)
    asked = F.array_contains("labels", "episode") | looks_like_request(F.col("body"))
    ok = ~F.coalesce("pull_request", F.lit(False)) & (F.coalesce("state", F.lit("open")) == "open") & asked & ~F.array_contains("labels", "clipped") & F.coalesce(trusted, F.lit(False))
    return issues.where(ok)


def _strip(c: Column) -> Column:
    return T.stripped(c)


def issue_fields(issues: DataFrame) -> DataFrame:
    """(number, client, source, title, notes, count) of issues (number, title, body, labels), from headings, ``key: value`` lines and labels.

    A heading that comes again replaces its value, in its first place; a line counts only where no heading and no line before
    has its key.
    """
    # Results depend on these patterns.
    headings, line = r"(?m)^#{2,4}\s+", r"(?mi)^\s*\**([a-z][a-z ]{1,24}?)\**\s*:\s*(\S.*)$"
    body = F.replace(F.coalesce("body", F.lit("")), F.lit("\r\n"), F.lit("\n"))
    blocks = F.slice(F.split(body, headings), F.lit(2), F.lit(1_000_000))
    headed = F.transform(blocks, lambda b: F.struct(F.lower(_strip(F.substring_index(b, "\n", 1))).alias("k"), F.when(b.contains("\n"), _strip(F.regexp_replace(b, r"^[^\n]*\n", ""))).otherwise("").alias("v")))
    keys, values = F.regexp_extract_all(body, F.lit(line), F.lit(1)), F.regexp_extract_all(body, F.lit(line), F.lit(2))
    typed = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda z: F.struct(F.lower(_strip(z["k"])).alias("k"), _strip(F.trim(_strip(z["v"]), F.lit("*"))).alias("v")))
    x = issues.withColumn("_h", headed).withColumn("_t", typed).withColumn("_hk", F.array_distinct(F.transform("_h", lambda f: f["k"])))
    x = x.withColumn("_tk", F.array_except(F.transform("_t", lambda f: f["k"]), "_hk"))
    value = lambda fields, k, at: F.struct(k.alias("k"), F.element_at(F.filter(fields, lambda f: f["k"] == k), at)["v"].alias("v"))
    x = x.withColumn("_f", F.concat(F.transform("_hk", lambda k: value("_h", k, -1)), F.transform("_tk", lambda k: value("_t", k, 1))))

    def first(*names: str) -> Column:
        found = [F.try_element_at(F.filter("_f", lambda f: f["k"].startswith(n) & ~F.lower(f["v"]).isin(EMPTY)), F.lit(1))["v"] for n in names]  # noqa: B023
        return F.coalesce(*found, F.lit(""))

    client = F.lower(F.trim(first("client", "show"), F.lit("`")))
    label = F.try_element_at(F.filter("labels", lambda l: F.lower(l).startswith("client:")), F.lit(1))
    client = F.when(client != "", client).otherwise(F.coalesce(F.lower(_strip(F.regexp_replace(label, r"^[^:]*:", ""))), F.lit("")))
    told = first("episode link", "link", "url", "source", "file", "episode file")
    link = F.coalesce(F.nullif(F.regexp_extract(told, LINK, 0), F.lit("")), F.regexp_extract(body, LINK, 0))
    number = first("number of clips", "clips", "count")
    count = F.when(number.rlike(r"^\d+$"), number.try_cast("int"))
    title = first("episode title", "title")
    own_title = F.regexp_replace(_strip(F.coalesce("title", F.lit(""))), r"(?i)^episode:?\s*$", "")
    return x.select("number", client.alias("client"), F.rtrim(link, F.lit(".,;")).alias("source"), F.when(title != "", title).otherwise(own_title).alias("title"), first("notes", "note", "focus").alias("notes"), F.when(count.between(1, 30), count).alias("count"))


def not_filed(items: DataFrame, issues: DataFrame, kind: str = "feed") -> DataFrame:
    """Items (key, ...) whose key no issue body carries as ``kind-item:key``."""
    filed = issues.select(F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(rf"{kind}-item:([0-9A-Za-z-]+)"), F.lit(1))).alias("key")).distinct()
    return items.join(filed, "key", "left_anti")


def fresh(items: DataFrame, now: Column, days: int = 7, limit: int = 2) -> DataFrame:
    """Of each feed's items (feed, key, published in seconds, ...) the newest of the last days; without a time they are not new."""
    w = Window.partitionBy("feed").orderBy(F.desc("published"), "key")
    recent = items.where(F.col("published") >= now - days * 86400)
    return recent.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def unfiled_broadcasts(listed: DataFrame, read: DataFrame, issues: DataFrame, now: Column, min_minutes: float, max_age: float = 4 * 86400.0) -> DataFrame:
    """Broadcasts to file, from listings (ord, platform, id, live, duration, title) and what reading each gave (platform, id, key,
    live, duration, started, title): not live, not filed under the listing's id nor under the key it turned out to have, long
    enough, recent, and each key once, the first in order.
    """
    filed = issues.select(F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"stream-item:([\w-]+)"), F.lit(1))).alias("key")).distinct()
    known = F.concat(F.col("platform"), F.lit("-"), F.left(F.regexp_replace("id", r"[^A-Za-z0-9]", ""), F.lit(40)))
    new = listed.where(~F.col("live")).withColumn("_known", known).join(filed.withColumnRenamed("key", "_known"), "_known", "left_anti").drop("_known")
    r = read.select("platform", "id", "key", F.col("live").alias("_live"), F.col("duration").alias("_duration"), "started", F.col("title").alias("_title"))
    x = new.join(r, ["platform", "id"]).where(~F.col("_live")).join(filed, "key", "left_anti")
    x = x.withColumn("duration", F.coalesce(F.nullif(F.col("_duration"), F.lit(0.0)), "duration")).withColumn("title", F.coalesce(F.nullif(F.col("_title"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.lit("Stream")))
    length = F.coalesce("duration", F.lit(0.0))
    x = x.where(~((length > 0) & (length < min_minutes * 60)) & ~F.coalesce((F.coalesce("started", F.lit(0.0)) > 0) & (now - F.col("started") - length > max_age), F.lit(False)))
    once = x.groupBy("key").agg(F.min_by(F.struct("ord", "platform", "id", "title", "duration"), "ord").alias("x"))
    return once.select("key", "x.*")


def latest_finished(broadcasts: DataFrame) -> DataFrame:
    """The first finished broadcast of each channel's listing (channel, ord, live, ...)."""
    w = Window.partitionBy("channel").orderBy("ord")
    return broadcasts.where(~F.col("live")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_client(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """requests with the client they name, or the only real one (clients has client, real) where they name none; null if several are real."""
    only = clients.where("real").agg(F.when(F.count("*") == 1, F.first("client")).alias("_only"))
    return requests.crossJoin(F.broadcast(only)).withColumn("client", F.coalesce(F.nullif(F.col("client"), F.lit("")), "_only")).drop("_only")


def watchable(broadcasts: DataFrame, now: Column, min_minutes: float, max_age: float = 4 * 86400.0) -> DataFrame:
    """Finished broadcasts that are long enough and whose end is recent; without a start they count as recent."""
    fresh = F.col("started").isNull() | (now - (F.col("started") + F.col("duration")) <= max_age)
    return broadcasts.where(~F.col("live") & (F.col("duration") >= min_minutes * 60) & fresh)


def next_run(queued: DataFrame, cap: int = 6) -> DataFrame:
    """(number, place) of the first ``cap`` distinct requests, in the order of ``ord``."""
    once = queued.groupBy("number").agg(F.min("ord").alias("ord"))
    return once.orderBy("ord", "number").limit(cap).withColumn("place", F.row_number().over(Window.orderBy("ord", "number"))).select("number", "place")


def unnoticed(notices: DataFrame, issues: DataFrame) -> DataFrame:
    """Notices (notice_id, client, text) whose text no open issue of that client contains."""
    return notices.alias("n").join(issues.where("state = 'open'").alias("i"), (F.col("n.client") == F.col("i.client")) & F.col("i.body").contains(F.col("n.text")), "left_anti")


def viewer_hints(clips: DataFrame, recordings: DataFrame, lead: float = 30.0, limit: int = 25) -> DataFrame:
    """(rec_id, at, views, title): viewers' clips on the recording's clock, the most viewed of each recording."""
    x = clips.join(recordings, "rec_id").withColumn("at", F.col("created") - F.col("started") - lead).where(F.col("at").between(0, F.col("duration")))
    w = Window.partitionBy("rec_id").orderBy(F.desc("views"), "clip_id")
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).select("rec_id", F.round("at", 1).alias("at"), "views", "title")


# People read these texts.
STUCK = (
    "An earlier run on this episode stopped without finishing, most likely because it ran out of time. It was not retried automatically. "
    "If the episode is very long, try a shorter cut of it or a faster transcribe.model for this client."
)
SILENT = "The run stopped before it could report a reason. The run log has the details."
FAILED = "### Could not make clips\n\n%s\n\nTo try again, fix the problem (edit the issue if the link was wrong), then start the Clips workflow by hand with this issue's number, or remove the `failed` label and the nightly run will take it. [Run log](%s)\n"


def label_steps(issues: DataFrame, events: DataFrame) -> DataFrame:
    """(number, seq, kind, action, added, removed, labels, comment): what each event of events (number, seq, kind, reason, log) does to an issue.

    issues is (number, labels).  ``start`` skips an issue that is clipped or failed, and fails one that is still processing, since the run
    before never reported; any other is processing from then on.  ``publish`` and ``fail`` end the run; other kinds do nothing.  Labels
    stay in order, new ones last.  Events of unknown issues are left out.

    After a publish or a failure every start skips, so the labels follow from the first ones, the last end, whether anything was
    published and how many starts there were: running values of one window, and no event meets more than one issue.
    """
    before = Window.partitionBy("number").orderBy("seq", "kind", "reason", "log").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.coalesce("kind", F.lit(""))
    ends, starts, publishes = kind.isin("publish", "fail"), kind == "start", kind == "publish"
    so_far = events.select(
        "number", "seq", "kind", "reason", "log", F.last(F.when(ends, kind), ignorenulls=True).over(before).alias("_end"),
        F.coalesce(F.max(publishes).over(before), F.lit(False)).alias("_out"), F.coalesce(F.sum(starts.cast("long")).over(before), F.lit(0)).alias("_starts"),
    )
    none = F.array().cast("array<string>")
    had = lambda name: F.coalesce(F.array_contains("labels", name), F.lit(False)).alias(f"_{name}")
    first = issues.select("number", F.array_distinct(F.coalesce("labels", none)).alias("labels"), had("processing"), had("failed"), had("clipped"))
    x = so_far.join(first, "number")

    def state(end: Column, out: Column, n: Column) -> tuple[Column, Column, Column]:
        """Whether an issue is processing, failed and clipped after n starts, of which the second of one run fails."""
        idle = F.col("_failed") | F.col("_clipped")
        runs = F.when(idle, 0).otherwise(n + F.col("_processing").cast("long"))
        stuck = runs >= 2
        return end.isNull() & ~stuck & (F.col("_processing") | (runs == 1)), F.when(end.isNull(), F.col("_failed") | stuck).otherwise(end == "fail"), F.col("_clipped") | out

    was, now = ("_end", "_out", "_starts"), (F.coalesce(F.when(ends, kind), "_end"), F.col("_out") | publishes, F.col("_starts") + starts.cast("long"))
    x = x.select("*", *[c.alias(f"_was_{i}") for i, c in enumerate(state(*map(F.col, was)))], *[c.alias(f"_now_{i}") for i, c in enumerate(state(*now))], now[1].alias("_published"))
    processing, failed, clipped = (F.col(f"_was_{i}") for i in range(3))
    action = F.when(ends, kind).when(~starts, "none").when(clipped | failed, "skip").when(processing, "fail").otherwise("start")
    x = x.withColumn("action", action)
    name = lambda given, c: F.when(given, F.array(F.lit(c))).otherwise(none)
    does = lambda what: F.col("action") == what
    added = F.when(does("publish"), name(~clipped, "clipped")).when(does("fail"), name(~failed, "failed")).when(does("start"), name(F.lit(True), "processing")).otherwise(none)
    removed = F.when(does("publish"), F.concat(name(processing, "processing"), name(failed, "failed"))).when(does("fail"), name(processing, "processing")).otherwise(none)
    processing, failed, clipped = (F.col(f"_now_{i}") for i in range(3))
    # a label that is there already stays where it is
    moved = F.col("_published") | ~failed
    kept = F.when(~processing, F.array_remove("labels", "processing")).otherwise(F.col("labels"))
    kept = F.when(moved, F.array_remove(kept, "failed")).otherwise(kept)
    labels = F.concat(kept, name(processing & ~F.col("_processing"), "processing"), name(clipped & ~F.col("_clipped"), "clipped"), name(failed & (moved | ~F.col("_failed")), "failed"))
    told = F.coalesce(T.stripped("reason"), F.lit(""))
    reason = F.when(starts, STUCK).when(told == "", SILENT).otherwise(F.left(told, F.lit(3000)))
    head, middle, tail = map(F.lit, FAILED.split("%s"))
    comment = F.when(does("fail"), F.concat(head, reason, middle, F.coalesce("log", F.lit("")), tail))
    return x.select("number", "seq", "kind", "action", added.alias("added"), removed.alias("removed"), labels.alias("labels"), comment.alias("comment"))
