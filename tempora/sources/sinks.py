"""Manifests, review sheets, comments, subtitles and transcripts as text columns; writing them is df.write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import glyphs as G
from tempora.functions import text as T


def in_order(key: str, text: Column, between: str) -> Column:
    """The texts of a group, in the order of key, as one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text.alias("t")))), lambda x: x["t"]), between)


def manifests(clips: DataFrame, runs: DataFrame, fields: tuple[str, ...] = ("rank", "first", "last", "title", "caption", "hashtags", "why", "score")) -> DataFrame:
    """(rec_id, manifest): a run (rec_id, client, show, title, source, picker, model, notes array) and its clips, best first, as one JSON text.

    Empty notes are left out, the others joined.  Runs on long recordings have a struct ``recording`` (platform, channel, length, skimmed,
    stretches) as well, null elsewhere; where over a minute of it was not looked at, a note says so.
    """
    extra = []
    if "recording" in runs.columns:
        r = F.col("recording")
        less = F.when(r["length"] > r["skimmed"] + 60, F.concat(F.lit("Only the first "), T.clock(r["skimmed"]), F.lit(" of this "), T.clock(r["length"]), F.lit(" stream was looked at.")))
        runs, extra = runs.withColumn("notes", F.concat("notes", F.array(less))), ["recording"]
    per = clips.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("clips"))
    note = F.array_join(F.filter("notes", lambda n: F.coalesce(n, F.lit("")) != ""), " ").alias("note")
    return runs.join(per, "rec_id").select("rec_id", F.to_json(F.struct("client", "show", "title", "source", "picker", "model", "clips", *extra, note)).alias("manifest"))


def _heading(runs: DataFrame) -> DataFrame:
    return runs.withColumn("_heading", F.array_join(F.filter(F.array("show", "title"), lambda x: x != ""), " — "))


def _looked_at(runs: DataFrame) -> Column:
    """A line on a long recording, empty where runs have none."""
    if "recording" not in runs.columns:
        return F.lit("")
    r = F.col("recording")
    return F.coalesce(F.concat(F.lit("\nFrom a "), T.clock(r["length"]), F.lit(" stream. "), r["stretches"].cast("string"), F.lit(" stretches of it were looked at closely.\n")), F.lit(""))


def review_sheets(clips: DataFrame, runs: DataFrame, whole: str = "episode") -> DataFrame:
    """(rec_id, sheet): the markdown list of clips (rec_id, rank, title, file, duration, source_start, source_end, trimmed, post, why,
    text, watch) of runs (rec_id, show, title, picker, model, note).  Runs on long recordings may have a struct recording (length,
    stretches): they are streams, and how much of them was looked at is told.  Fixed values: people read these texts.
    """
    long = F.col("recording").isNotNull() if "recording" in runs.columns else F.lit(False)
    told = _looked_at(runs)
    clips = clips.join(runs.select("rec_id", F.when(long, "stream").otherwise(whole).alias("_whole")), "rec_id")
    linked = F.when(F.coalesce("watch", F.lit("")) != "", F.concat(F.lit(" ([watch it there]("), "watch", F.lit("))"))).otherwise("")
    where = F.concat(F.lit("from "), T.clock("source_start"), F.lit(" to "), T.clock("source_end"), F.lit(" of the "), "_whole", linked)
    less = F.when(F.col("trimmed") >= 0.5, F.format_string("%.1fs of pauses removed", "trimmed"))
    facts = F.concat_ws(" · ", F.concat(F.lit("`"), "file", F.lit("`")), T.clock("duration"), where, less)
    why = F.when(F.coalesce("why", F.lit("")) != "", F.concat(F.lit("\n\n**Why this one:** "), "why")).otherwise("")
    entry = F.concat(F.format_string("\n## %d. %s\n\n", "rank", "title"), facts, F.lit("\n\n**Post text**\n\n"), "post", why, F.lit("\n\n**What is said:** "), "text")
    per = clips.groupBy("rec_id").agg(F.count("*").alias("_n"), in_order("rank", entry, "\n").alias("_body"))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n> "), "note", F.lit("\n"))).otherwise("")
    count = F.concat(F.col("_n").cast("string"), F.when(F.col("_n") == 1, " clip").otherwise(" clips"), F.lit(", best first. "), T.picker_line("picker", "model"))
    x = _heading(runs).join(per, "rec_id")
    return x.select("rec_id", F.concat(F.lit("# "), "_heading", F.lit("\n\n"), count, F.lit("\n"), told, note, "_body", F.lit("\n")).alias("sheet"))


def comment_tables(clips: DataFrame, runs: DataFrame) -> DataFrame:
    """(rec_id, comment): what is said under a request when its clips are ready; runs have release_url and download_url too.
    A recording is told of as in review_sheets.  Fixed values: people read these texts.
    """
    at = F.when(F.coalesce("watch", F.lit("")) != "", F.concat(F.lit("["), T.clock("source_start"), F.lit("]("), "watch", F.lit(")"))).otherwise(T.clock("source_start"))
    c = clips.join(runs.select("rec_id", "download_url"), "rec_id")
    row = F.concat(F.format_string("| %d | ", "rank"), F.replace("title", F.lit("|"), F.lit("\\|")), F.lit(" | "), T.clock("duration"), F.lit(" | "), at, F.lit(" | ["), "file", F.lit("]("), "download_url", F.lit("/"), "file", F.lit(") |"))
    why = F.when(F.coalesce("why", F.lit("")) != "", F.concat(F.lit("\n_Why:_ "), "why", F.lit("\n"))).otherwise("")
    more = F.concat(F.format_string("**%d. %s**\n\n", "rank", "title"), "post", F.lit("\n"), why)
    per = c.groupBy("rec_id").agg(F.count("*").alias("_n"), in_order("rank", row, "\n").alias("_rows"), in_order("rank", more, "\n").alias("_more"))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n> **Note:** "), "note", F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("### "), F.col("_n").cast("string"), F.when(F.col("_n") == 1, " clip ready\n\n").otherwise(" clips ready\n\n"), T.picker_line("picker", "model"), F.lit(" [All files and the contact sheet]("), "release_url", F.lit(")\n"), _looked_at(runs), note)
    table = F.concat(F.lit("\n| # | Headline | Length | Starts at | File |\n|---|---|---|---|---|\n"), "_rows", F.lit("\n\n<details><summary>Post text and reasons</summary>\n\n"), "_more", F.lit("\n</details>\n"))
    return runs.join(per, "rec_id").select("rec_id", F.concat(head, table).alias("comment"))


def subtitle_events(events: DataFrame, place: int, colour: str = "#FFFFFF", highlight: str = "#FFD400", size: float = 72.0, width: float = 900.0, glyphs: G.Glyphs = G.PLAIN) -> DataFrame:
    """(rec_id, chunk, pos, event): subtitle lines for caption events (rec_id, chunk, pos, start, until, words), each lighting up one word.

    A caption too long for the line is squeezed; any other pops up with its first word.  Fixed values: players read these tags.
    """
    long = glyphs.pixels(glyphs.width(F.array_join("words", " ")), size)
    share = F.bround(F.lit(width) / long * 100, 0).cast("int")
    more = F.when(long > width, F.concat(F.lit("\\fscx"), share.cast("string"), F.lit("\\fscy"), share.cast("string"))).when(F.col("pos") == 0, "\\fscx92\\fscy92\\t(0,70,\\fscx100\\fscy100)").otherwise("")
    tag = lambda c: F.concat(F.lit("{"), T.inline_colour(F.lit(c)), F.lit("}"))
    pos = F.col("pos").cast("int")
    said = F.concat_ws(" ", F.slice("words", F.lit(1), pos), F.concat(tag(highlight), F.get("words", pos), tag(colour)), F.slice("words", pos + 2, F.size("words")))
    event = F.concat(F.lit("Dialogue: 0,"), T.ass_time("start"), F.lit(","), T.ass_time("until"), F.lit(",Cap,,0,0,0,,"), F.lit(f"{{\\an5\\pos(540,{place})"), more, F.lit("}"), said)
    return events.select("rec_id", "chunk", "pos", event.alias("event"))


def subtitle_files(events: DataFrame, header: str) -> DataFrame:
    """(rec_id, text): a header and the events of a recording in order."""
    return events.groupBy("rec_id").agg(F.concat(F.lit(header), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "pos", "event"))), lambda x: x["event"]), "\n"), F.lit("\n")).alias("text"))


def transcript_json(words: DataFrame, pauses: DataFrame, facts: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(rec_id, json): words as [text, start, end] to three decimals and pauses by word to two, with facts (rec_id, language, duration, model)
    and the parts (rec_id, idx, start, end, origin, file, offset, why) of recordings that have any.
    """
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    word = F.concat(F.lit("["), quoted(F.col("text")), F.lit(","), F.round("start", 3).cast("string"), F.lit(","), F.round("end", 3).cast("string"), F.lit("]"))
    w = words.groupBy("rec_id").agg(in_order("word_idx", word, ",").alias("_w"))
    pause = F.concat(F.lit('"'), F.col("word_idx").cast("string"), F.lit('":'), F.round("length", 2).cast("string"))
    p = pauses.groupBy("rec_id").agg(in_order("word_idx", pause, ",").alias("_p"))
    x = facts.join(w, "rec_id").join(p, "rec_id", "left")
    if parts is None:
        x = x.withColumn("_q", F.lit(""))
    else:
        number = lambda c: F.round(c, 3).cast("string")
        part = F.concat(
            F.lit('{"index":'), F.col("idx").cast("string"), F.lit(',"start":'), number("start"), F.lit(',"end":'), number("end"), F.lit(',"origin":'), number("origin"),
            F.lit(',"file":'), quoted(F.coalesce("file", F.lit(""))), F.lit(',"offset":'), number("offset"), F.lit(',"why":'), quoted(F.coalesce("why", F.lit(""))), F.lit("}"),
        )
        x = x.join(parts.groupBy("rec_id").agg(in_order("idx", part, ",").alias("_q")), "rec_id", "left")
    return x.select("rec_id", F.concat(F.lit('{"version":1,"language":'), quoted(F.col("language")), F.lit(',"duration":'), F.round("duration", 3).cast("string"), F.lit(',"model":'), quoted(F.col("model")), F.lit(',"pauses":{'), F.coalesce("_p", F.lit("")), F.lit('},"parts":['), F.coalesce("_q", F.lit("")), F.lit('],"words":['), "_w", F.lit("]}")).alias("json"))


def _labels(letter: str, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.concat(F.lit(f"[{letter}"), i.cast("string"), F.lit("]"))), "")


def video_chains(pieces: DataFrame, layout: Callable[[Column], Column], fps: int = 30) -> DataFrame:
    """(rec_id, clip, chain): the filter graph that lays out and joins the pictures of pieces (rec_id, clip, first, last, width, height, ...).

    Pictures are put on an exact grid of frames from the clip's start, and the last one is held, so that frame numbers are
    moments whatever the source's rate.  layout is the filter text of a piece for a tag that keeps its labels apart, over the
    columns of pieces.  Fixed values: an encoder reads these texts.
    """
    w = Window.partitionBy("rec_id", "clip")
    x = pieces.withColumn("_i", F.row_number().over(w.orderBy("first")) - 1).withColumn("_n", F.count("*").over(w))
    number = F.col("_i").cast("string")
    laid = F.concat(F.format_string("trim=start_frame=%d:end_frame=%d,setpts=PTS-STARTPTS,", "first", "last"), layout(F.concat(F.lit("s"), number)))
    piece = F.concat(F.lit("[v"), number, F.lit("]"), laid, F.when(F.col("_n") > 1, F.concat(F.lit("[p"), number, F.lit("]"))).otherwise("[vcat]"))
    per = x.groupBy("rec_id", "clip", "_n").agg(in_order("_i", piece, ";").alias("_pieces"), F.min_by(F.struct("width", "height"), "_i").alias("_size"))
    head = F.format_string(f"[0:V:0]fps={fps}:start_time=0,tpad=stop_mode=clone:stop_duration=1.5,scale=%d:%d:flags=bicubic,format=yuv420p,setsar=1", "_size.width", "_size.height")
    many = F.concat(head, F.lit(",split="), F.col("_n").cast("string"), _labels("v", F.col("_n")), F.lit(";"), "_pieces", F.lit(";"), _labels("p", F.col("_n")), F.format_string("concat=n=%d:v=1:a=0[vcat]", "_n"))
    return per.select("rec_id", "clip", F.when(F.col("_n") == 1, F.concat(head, F.lit("[v0];"), "_pieces")).otherwise(many).alias("chain"))


def audiogram_chains(clips: DataFrame, fps: int = 30) -> DataFrame:
    """(rec_id, clip, chain): the picture of clips (rec_id, clip, duration, cover, colour) that are sound only: a moving waveform over
    the cover or a plain ground; cover is whether there is one, colour #RRGGBB.  Fixed values: an encoder reads these texts.
    """
    wave = F.concat(F.lit(f"[aw]showwaves=s=960x280:mode=cline:rate={fps}:colors=0x"), F.substring("colour", 2, 6), F.lit(":scale=sqrt:draw=full,format=yuva420p[wave]"))
    length = F.format_string("%.3f", "duration")
    cover = F.concat(
        F.lit(f"[1:v]fps={fps},format=yuv420p,split=2[c1][c2];[c1]scale=270:480:force_original_aspect_ratio=increase,crop=270:480,boxblur=12:2,scale=1080:1920:flags=bilinear,eq=brightness=-0.22:saturation=0.85[bg];"),
        F.lit("[c2]scale=640:640:force_original_aspect_ratio=increase,crop=640:640[art];[bg][art]overlay=(W-w)/2:300[base];"), wave,
        F.lit(";[base][wave]overlay=(W-w)/2:1000:shortest=1,trim=duration="), length, F.lit(",setsar=1[vcat]"),
    )
    plain = F.concat(F.lit(f"color=c=0x12161c:s=1080x1920:r={fps}:d="), length, F.lit("[base];"), wave, F.lit(";[base][wave]overlay=(W-w)/2:700:shortest=1,setsar=1[vcat]"))
    return clips.select("rec_id", "clip", F.when(F.col("cover"), cover).otherwise(plain).alias("chain"))


def contact_sheets(thumbs: DataFrame) -> DataFrame:
    """(rec_id, graph): the filter graph that shows thumbs (rec_id, rank, file) of a run on one sheet, five in a row; null files are left out.

    Fixed values: an encoder reads these texts.
    """
    x = thumbs.where("file is not null").withColumn("_i", F.row_number().over(Window.partitionBy("rec_id").orderBy("rank")) - 1)
    n = F.col("_n")
    scaled = F.format_string("[%d:v]scale=360:640,setsar=1[%s]", F.col("_i"), F.when(n == 1, F.lit("sheet")).otherwise(F.concat(F.lit("t"), F.col("_i").cast("string"))))
    columns = F.least(F.lit(5), n)
    place = F.format_string("%d_%d", F.col("_i") % columns * 368, F.floor(F.col("_i") / columns) * 648)
    x = x.withColumn("_n", F.count("*").over(Window.partitionBy("rec_id")))
    per = x.groupBy("rec_id", "_n").agg(in_order("_i", scaled, ";").alias("_scaled"), in_order("_i", place, "|").alias("_places"))
    stacked = F.concat("_scaled", F.lit(";"), _labels("t", n), F.format_string("xstack=inputs=%d:layout=%s:fill=black[sheet]", n, F.col("_places")))
    return per.select("rec_id", F.when(n == 1, F.col("_scaled")).otherwise(stacked).alias("graph"))


def sound_graphs(frames: DataFrame, clips: DataFrame, fps: int = 30) -> DataFrame:
    """(rec_id, clip, graph): the filter graph that joins the sound of frames (rec_id, clip, piece, first, last), joins faded, and levels
    it by the gain (decibels, see steady_gain) of clips (rec_id, clip, gain, wave); with wave a copy of the sound is left for a
    waveform.  Fixed values: an encoder reads these texts.
    """
    w = Window.partitionBy("rec_id", "clip")
    x = frames.withColumn("_i", F.row_number().over(w.orderBy("piece")) - 1).withColumn("_n", F.count("*").over(w))
    cut = F.format_string("atrim=start=%.5f:end=%.5f", F.col("first") / float(fps), F.col("last") / float(fps))
    out = F.format_string("afade=t=out:st=%.5f:d=0.008", F.greatest(F.lit(0.0), (F.col("last") - F.col("first")) / float(fps) - 0.008))
    chain = F.concat_ws(",", cut, F.lit("asetpts=PTS-STARTPTS"), F.when(F.col("_i") > 0, "afade=t=in:st=0:d=0.008"), F.when(F.col("_i") < F.col("_n") - 1, out))
    part = F.concat(F.format_string("[a%d]", "_i"), chain, F.format_string("[q%d]", "_i"))
    head = "[0:a:0]aresample=48000,aformat=sample_fmts=fltp:channel_layouts=stereo,apad=pad_dur=1.5"
    per = x.groupBy("rec_id", "clip", "_n").agg(in_order("_i", part, ";").alias("_parts"), F.first(chain).alias("_one")).join(clips, ["rec_id", "clip"])
    many = F.concat(F.lit(head + ",asplit="), F.col("_n").cast("string"), _labels("a", F.col("_n")), F.lit(";"), "_parts", F.lit(";"), _labels("q", F.col("_n")), F.format_string("concat=n=%d:v=0:a=1[acat]", "_n"))
    level = F.concat(F.format_string(";[acat]volume=%.2fdB,alimiter=limit=0.84:attack=5:release=50:level=false:latency=1,aresample=48000", "gain"), F.when(F.col("wave"), ",asplit=2[aout][aw]").otherwise("[aout]"))
    return per.select("rec_id", "clip", F.concat(F.when(F.col("_n") == 1, F.concat(F.lit(head + ","), "_one", F.lit("[acat]"))).otherwise(many), level).alias("graph"))


def subtitle_head(font: str, size: float, colour: str = "#FFFFFF", outline_colour: str = "#000000", glyphs: G.Glyphs = G.PLAIN) -> Column:
    """The head of a subtitle file: the picture's size, the styles of captions and headline.  Fixed values: players read these texts."""
    small, outline = round(size * 0.66), max(3, round(size * 0.085))
    main, line, shade, dark, white, clear = (T.ass_colour(F.lit(c), a) for c, a in ((colour, 0), (outline_colour, 0), ("#000000", 0x78), ("#111111", 0), ("#FFFFFF", 0), ("#000000", 0xFF)))
    rest = "-1,0,0,0,100,100,0,0"
    fields = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
    return F.concat(
        F.lit("[Script Info]\nScriptType: v4.00+\nPlayResX: 1080\nPlayResY: 1920\nWrapStyle: 2\nScaledBorderAndShadow: yes\nYCbCr Matrix: TV.709\n\n[V4+ Styles]\n"),
        F.concat(F.lit(f"Format: {fields}\nStyle: Cap,{font},{glyphs.ass_size(size)},"), F.concat_ws(",", main, main, line, shade), F.lit(f",{rest},1,{outline},{max(2, outline // 2)},5,40,40,0,1\n")),
        F.concat(F.lit(f"Style: Title,{font},{glyphs.ass_size(small)},"), F.concat_ws(",", dark, dark, white, clear), F.lit(f",{rest},3,{round(small * 0.28)},0,5,40,40,0,1\n")),
        F.lit("\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"),
    )


def headline_events(clips: DataFrame, size: float = 72.0, glyphs: G.Glyphs = G.PLAIN) -> DataFrame:
    """(rec_id, clip, event): the subtitle line of the headline of clips (rec_id, clip, title, duration, title_y, floor, until).

    Two lines are the aim: a longer headline is set smaller before it takes a third.  It stays below the safe top, and above
    floor (null: anywhere).  It fades out if the clip goes on for 0.3 s or more.  No title, or until at 0 or before: no row.  Fixed values:
    players read these tags.
    """
    usual = round(size * 0.66)
    less, pad = round(usual * 0.86), 2 * round(usual * 0.28)
    shown = T.display_word("title", False)
    x = clips.where("title <> '' and until > 0").withColumn("_l", G.wrapped_title(shown, usual, glyphs=glyphs))
    small = F.size("_l") > 2
    x = x.withColumn("_small", small).withColumn("_l", F.when(small, G.wrapped_title(shown, less, glyphs=glyphs)).otherwise(F.col("_l")))
    block = F.size("_l") * F.when(F.col("_small"), less).otherwise(usual) * glyphs.line_ratio + pad
    low = F.when(F.col("floor").isNotNull(), F.least(F.col("title_y").cast("double"), F.col("floor") - block / 2)).otherwise(F.col("title_y").cast("double"))
    y = F.greatest(low, 120 + block / 2).cast("int")
    resize = F.when(F.col("_small"), f"\\fs{glyphs.ass_size(less)}").otherwise("") if less != usual else F.lit("")
    fade = F.when(F.col("until") < F.col("duration") - 0.3, "\\fad(0,250)").otherwise("")
    head = F.concat(F.lit("Dialogue: 1,"), T.ass_time(F.lit(0.0)), F.lit(","), T.ass_time(F.least("until", "duration")), F.lit(",Title,,0,0,0,,{\\an5\\pos(540,"), y.cast("string"), F.lit(")"), resize, fade, F.lit("}"))
    return x.select("rec_id", "clip", F.concat(head, F.array_join("_l", "\\N")).alias("event"))
