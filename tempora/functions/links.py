"""Column builders over links and loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists and patterns.
TWITCH_HOSTS = ["twitch.tv", "www.twitch.tv", "m.twitch.tv", "go.twitch.tv"]
KICK_HOSTS = ["kick.com", "www.kick.com"]
NOT_CHANNELS = [
    "videos", "video", "directory", "settings", "subscriptions", "inventory", "wallet", "drops", "p", "jobs", "downloads", "turbo", "search", "store", "prime", "login", "signup", "user",
    "friends", "clips", "collections", "categories", "browse", "auth", "following", "dashboard", "api", "terms-of-service", "privacy-policy",
]
CHANNEL = r"^[A-Za-z0-9][A-Za-z0-9_-]{1,39}$"
UUID = r"^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
MEDIA_ENDINGS = ["mp4", "mov", "mkv", "webm", "mp3", "m4a", "wav", "flac", "ogg", "aac"]
DRIVE_HOSTS = ["drive.google.com", "docs.google.com", "drive.usercontent.google.com"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host_of(url: Column | str) -> Column:
    """Lower-case host of an http link, without user and port; null for other text."""
    found = F.lower(F.regexp_extract(F.trim(_c(url)), r"^https?://([^/?#]*)", 1))
    found = F.regexp_replace(F.regexp_replace(found, r"^.*@", ""), r":.*$", "")
    return F.when(F.trim(_c(url)).rlike(r"^https?://"), found)


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(F.trim(_c(url)), r"^https?://[^/?#]*([^?#]*)", 1)


def classify(url: Column | str) -> Column:
    """struct(platform, kind, key) of a stream link; null for any other."""
    host, path = host_of(url), path_of(url)
    words = F.filter(F.split(path, "/"), lambda w: w != "")
    n = F.size(words)
    word = [F.coalesce(F.get(words, F.lit(i)), F.lit("")) for i in range(3)]
    digits = r"^[0-9]+$"
    asked = F.regexp_extract(_c(url), r"[?&]vodID=([0-9]+)(&|#|$)", 1)
    first = F.regexp_replace(word[1], "^v+", "")
    found = lambda platform, kind, key: F.struct(F.lit(platform).alias("platform"), F.lit(kind).alias("kind"), key.alias("key"))
    plain = (n >= 1) & ~F.lower(word[0]).isin(NOT_CHANNELS) & word[0].rlike(CHANNEL)
    twitch = (
        F.when(asked != "", found("twitch", "vod", asked))
        .when((n >= 2) & (word[0] == "videos") & first.rlike(digits), found("twitch", "vod", first))
        .when((n >= 3) & word[1].isin("v", "video", "videos") & word[2].rlike(digits), found("twitch", "vod", word[2]))
        .when(plain & ((n == 1) | word[1].isin("videos", "about", "schedule", "clips")), found("twitch", "channel", F.lower(word[0])))
    )
    kick = (
        F.when((n >= 3) & (word[1] == "videos") & F.lower(word[2]).rlike(UUID), found("kick", "vod", F.lower(word[2])))
        .when((n >= 2) & (word[0] == "video") & F.lower(word[1]).rlike(UUID), found("kick", "vod", F.lower(word[1])))
        .when(plain & ((n == 1) | word[1].isin("videos", "about", "clips")), found("kick", "channel", F.lower(word[0])))
    )
    listed = F.when(F.lower(path).endswith(".m3u8"), found("hls", "playlist", F.left(F.sha1(_c(url)), F.lit(12))))
    return F.when(host.isin(TWITCH_HOSTS), twitch).when(host.isin(KICK_HOSTS), kick).when(host.isNotNull(), listed)


def is_long(url: Column | str, kind: Column | str) -> Column:
    """Whether a recording is skimmed first: a stream's link, or what its client says is a stream."""
    return classify(url).isNotNull() | F.coalesce(_c(kind) == "stream", F.lit(False))


def channel_name(value: Column | str, platform: str) -> Column:
    """A channel from its name, @name or link; empty for none, null for what is no channel of the platform."""
    v = F.trim(F.coalesce(_c(value), F.lit("")))
    host = "twitch.tv" if platform == "twitch" else "kick.com"
    found = classify(F.when(v.contains("://"), v).otherwise(F.concat(F.lit(f"https://{host}/"), F.ltrim(v, F.lit("@")))))
    return F.when(v == "", "").when((found["platform"] == platform) & (found["kind"] == "channel"), found["key"])


def channel_url(platform: Column | str, channel: Column | str) -> Column:
    return F.concat(F.when(_c(platform) == "twitch", "https://www.twitch.tv/").otherwise("https://kick.com/"), _c(channel))


def moment_url(kind: Column, seconds: Column | str) -> Column:
    """A link into a past broadcast at a moment; empty where the site has none."""
    t = F.greatest(F.lit(0), _c(seconds).cast("long"))
    at = F.format_string("https://www.twitch.tv/videos/%s?t=%dh%dm%ds", kind["key"], F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60)
    return F.coalesce(F.when((kind["platform"] == "twitch") & (kind["kind"] == "vod"), at), F.lit(""))


def file_ending(url: Column | str, default: str = "mp4") -> Column:
    """The media ending of a link's path, or the default."""
    found = F.lower(F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(found.isin(MEDIA_ENDINGS), found).otherwise(default)


def redact(url: Column | str) -> Column:
    """A link without its query and fragment."""
    return F.regexp_replace(_c(url), r"[?#].*$", "")


def normalize(url: Column | str) -> Column:
    """Shared files are asked for as downloads: dl=1 on Dropbox; other links stay."""
    at = F.regexp_replace(_c(url), r"([?&])dl=[0-9]", "$1dl=1")
    at = F.when(at.rlike(r"[?&]dl=1"), at).otherwise(F.concat(at, F.when(at.contains("?"), "&dl=1").otherwise("?dl=1")))
    return F.when(F.coalesce(host_of(url), F.lit("")).rlike(r"(^|\.)dropbox\.com$"), at).otherwise(_c(url))


def drive_id(url: Column | str) -> Column:
    """The file's id in a Drive link, or empty."""
    a = F.regexp_extract(_c(url), r"/d/([A-Za-z0-9_-]{10,})", 1)
    b = F.regexp_extract(_c(url), r"[?&]id=([^&#]*)", 1)
    return F.when(F.coalesce(host_of(url), F.lit("")).isin(DRIVE_HOSTS), F.when(a != "", a).otherwise(b)).otherwise("")


def broadcast_key(platform: Column | str, name: Column | str) -> Column:
    return F.concat(_c(platform), F.lit("-"), F.left(F.regexp_replace(_c(name), r"[^A-Za-z0-9]", ""), F.lit(40)))


def to_int(text: Column | str) -> Column:
    """A whole number through a decimal one; 0 for anything else."""
    return F.coalesce(F.when(_c(text).try_cast("double").between(-9e18, 9e18), _c(text).try_cast("double").cast("long")), F.lit(0).cast("long"))


def to_float(text: Column | str) -> Column:
    return F.coalesce(_c(text).try_cast("double"), F.lit(0.0))


def timestamp_of(text: Column | str) -> Column:
    """Unix seconds of a number or of an ISO date; without a zone it is UTC; null for anything else."""
    t = F.trim(_c(text))
    number = t.try_cast("double")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.concat(F.regexp_replace(t, " ", "T"), F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & t.rlike("[T ]"), "").when(t.rlike("[T ]"), "Z").otherwise("T00:00:00Z"))))
    return F.when(number > 0, number).otherwise(F.unix_micros(iso) / 1e6)
