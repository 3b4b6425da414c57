"""Splitting word sequences: clean words, sentences, replacements, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import glyphs as G
from tempora.functions import text as T
from tempora.operators.temporal import part_breaks


def clean_words(words: DataFrame) -> DataFrame:
    """Empty words go; starts never fall and are not negative; a word lasts 20 ms at least."""
    w = Window.partitionBy("rec_id").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0)
    kept = words.withColumn("text", T.stripped("text")).where("text <> ''")
    kept = kept.withColumn("start", F.greatest(F.max("start").over(w), F.lit(0.0)))
    return kept.withColumn("end", F.greatest(F.col("end"), F.col("start") + 0.02))


def rough_lines(phrases: DataFrame) -> DataFrame:
    """(rec_id, idx, start, end, text) of a quick model's phrases (rec_id, idx, start, end, text, logprob, no_speech).

    Guesses go (a low log-probability, or a fairly low one where there is hardly speech), and so do phrases that repeat the
    one kept before.  No phrase begins earlier than its words could take to say.
    """
    w = Window.partitionBy("rec_id").orderBy("idx")
    guess = (F.col("logprob") < -1.3) | ((F.col("no_speech") > 0.85) & (F.col("logprob") < -0.8))
    x = phrases.withColumn("text", T.folded("text")).where((F.col("text") != "") & ~F.coalesce(guess, F.lit(False)))
    x = x.withColumn("_was", F.lag("text").over(w)).where("_was is null or _was <> text")
    said = 0.45 * F.size(F.split("text", " ")) + 1.5
    return x.select("rec_id", (F.row_number().over(w) - 1).alias("idx"), F.greatest("start", F.col("end") - said).alias("start"), "end", "text")


def word_times(lines: DataFrame, extra: float = 1.5, gap: float = 0.02) -> DataFrame:
    """(rec_id, idx, pos, text, start, end): the words of lines (rec_id, idx, start, end, text), which share a line's time by their
    characters and ``extra`` each; a word ends ``gap`` before the next.  Lines without words have none.
    """
    words = lines.select("rec_id", "idx", F.col("start").alias("_a"), F.col("end").alias("_b"), F.posexplode(F.filter(F.split("text", f"{T.SPACE}+"), lambda w: w != "")).alias("pos", "text"))
    w = Window.partitionBy("rec_id", "idx")
    weight = F.char_length("text") + F.lit(extra)
    upto = F.sum(weight).over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda share: F.col("_a") + share / F.sum(weight).over(w) * (F.col("_b") - F.col("_a"))
    return words.select("rec_id", "idx", "pos", "text", at(upto - weight).alias("start"), (at(upto) - gap).alias("end"))


def hard_units(words: DataFrame, max_gap: float = 1.0, pauses: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """words with unit, soft and unit_end: units end at end punctuation, long gaps and pauses, where the part ends, and at the last word."""
    w = Window.partitionBy("rec_id").orderBy("word_idx")
    words = part_breaks(words, parts).drop("part_idx") if parts is not None else words.withColumn("part_end", F.lit(False))
    if pauses is not None:
        words = words.join(pauses.select("rec_id", "word_idx", F.col("length").alias("pause")), ["rec_id", "word_idx"], "left")
    else:
        words = words.withColumn("pause", F.lit(None).cast("double"))
    pause = F.coalesce("pause", F.lit(0.0))
    soft = T.is_soft_break("text")
    following = F.lead("start").over(w)
    ends = following.isNull() | T.is_sentence_end("text") | (following - F.col("end") >= max_gap) | (pause >= 0.7) | (soft & (pause >= 0.3)) | F.col("part_end")
    marked = words.withColumn("soft", soft).withColumn("unit_end", ends)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("unit", F.coalesce(F.sum(F.col("unit_end").cast("int")).over(before), F.lit(0)))


def sentences(words: DataFrame, max_gap: float = 1.0, max_words: int = 40, pauses: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(rec_id, idx, first, last, start, end, text); runaway units are cut at their last comma, if it comes late enough.

    The cuts are a fold over one unit at a time (units end at hard breaks), never over a whole recording, and a unit is cut where it
    lies: once the words are dealt by recording, none moves again.
    """
    marked = hard_units(words, max_gap, pauses, parts)
    unit = marked.groupBy("rec_id", "unit").agg(F.array_sort(F.collect_list(F.struct("word_idx", "soft", "unit_end", "start", "end", "text"))).alias("w"))
    seed = F.struct(F.element_at("w", 1)["word_idx"].cast("long").alias("begin"), F.lit(-1).cast("long").alias("comma"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, x: Column) -> Column:
        i, n = x["word_idx"].cast("long"), s["n"] + 1
        comma, at = F.when(x["soft"], i).otherwise(s["comma"]), F.when(x["soft"], n).otherwise(s["at"])
        late = comma - s["begin"] + 1 >= 12
        runs = ~x["unit_end"] & (i - s["begin"] + 1 >= max_words)
        begin = F.when(runs, F.when(late, comma).otherwise(i) + 1).otherwise(s["begin"])
        cuts = F.when(runs, F.concat(s["cuts"], F.array(F.when(late, at).otherwise(n)))).otherwise(s["cuts"])
        return F.struct(begin.alias("begin"), F.when(runs, F.lit(-1).cast("long")).otherwise(comma).alias("comma"), at.alias("at"), n.alias("n"), cuts.alias("cuts"))

    edges = F.concat(F.array(F.lit(0)), F.aggregate("w", seed, step)["cuts"], F.array(F.size("w")))
    cut = unit.select("rec_id", "w", edges.alias("_e")).select("rec_id", F.explode(F.transform(F.slice("_e", F.lit(2), F.size("_e")), lambda e, i: F.slice("w", F.get("_e", i) + 1, e - F.get("_e", i)))).alias("s"))
    first, last = F.element_at("s", 1), F.element_at("s", -1)
    found = cut.select("rec_id", first["word_idx"].alias("first"), last["word_idx"].alias("last"), first["start"].alias("start"), last["end"].alias("end"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))
    idx = (F.row_number().over(Window.partitionBy("rec_id").orderBy("first")) - 1).cast("long")
    return found.select("rec_id", idx.alias("idx"), "first", "last", "start", "end", "text")


def apply_replacements(words: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Fix recurring mis-hearings: longest patterns first, left to right, without overlap; the span is shared evenly.

    Matches of a rule are found by comparing each word and those after it (window functions); overlapping matches of one
    chain are settled by a fold over that chain only.
    """
    plain = [([T.bare_of(x) for x in w.split()], r.split()) for w, r in rules.items()]
    ordered = sorted(((w, r) for w, r in plain if w and all(w) and r), key=lambda x: -len(x[0]))
    if not ordered:
        return words.select("rec_id", "word_idx", F.lit(0).alias("sub_idx"), "text", "start", "end")
    longest = max(len(w) for w, _ in ordered)
    w = Window.partitionBy("rec_id").orderBy("word_idx")
    keyed = words.withColumn("key", T.bare("text"))
    ahead = [F.col("key") if k == 0 else F.lead("key", k).over(w) for k in range(longest)]
    keyed = keyed.select("*", *[a.alias(f"k{k}") for k, a in enumerate(ahead)])
    rule, size = F.lit(None).cast("int"), F.lit(1)
    for r in reversed(range(len(ordered))):
        pattern = ordered[r][0]
        hit = F.lit(True)
        for k, p in enumerate(pattern):
            hit = hit & F.coalesce(F.col(f"k{k}") == p, F.lit(False))
        rule, size = F.when(hit, F.lit(r)).otherwise(rule), F.when(hit, F.lit(len(pattern))).otherwise(size)
    found = keyed.withColumn("rule", rule).withColumn("size", size).drop("key", *[f"k{k}" for k in range(longest)])
    # chains of candidate matches that overlap each other
    reach = F.max(F.col("word_idx") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    chained = found.withColumn("_new", F.coalesce((F.col("word_idx") >= reach).cast("int"), F.lit(1)))
    chained = chained.withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = chained.groupBy("rec_id", "_chain").agg(F.array_sort(F.collect_list(F.struct("word_idx", "rule", "size", "text", "start", "end"))).alias("w"))
    seed = F.struct(F.lit(-1).cast("long").alias("free"), F.filter("w", lambda x: F.lit(False)).alias("taken"))

    def step(s: Column, x: Column) -> Column:
        takes = x["word_idx"] >= s["free"]
        return F.struct(F.when(takes, (x["word_idx"] + x["size"]).cast("long")).otherwise(s["free"]).alias("free"), F.when(takes, F.concat(s["taken"], F.array(x))).otherwise(s["taken"]).alias("taken"))

    heads = per.select("rec_id", "w", F.explode(F.aggregate("w", seed, step)["taken"]).alias("h"))
    tail = F.element_at(F.filter("w", lambda x: x["word_idx"] == F.col("h.word_idx") + F.col("h.size") - 1), 1)
    target = F.lit(None).cast("array<string>")
    for r, (_, right) in enumerate(ordered):
        target = F.when(F.col("h.rule") == r, F.array(*map(F.lit, right))).otherwise(target)
    lead = F.regexp_extract("h.text", r"^[.,;:!?\"'(\[{“‘-]*", 0)
    trail = F.regexp_extract(tail["text"], r"[.,;:!?\"')\]}”’]*$", 0)
    heads = heads.select("rec_id", "h", tail.alias("tail"), F.coalesce(target, F.array("h.text")).alias("target"), F.when(F.col("h.rule").isNotNull(), lead).otherwise("").alias("lead"), F.when(F.col("h.rule").isNotNull(), trail).otherwise("").alias("trail"))
    out = heads.select("*", F.posexplode("target").alias("sub_idx", "piece"))
    n = F.size("target")
    span = (F.col("tail.end") - F.col("h.start")) / n
    text = F.concat(F.when(F.col("sub_idx") == 0, F.col("lead")).otherwise(""), "piece", F.when(F.col("sub_idx") == n - 1, F.col("trail")).otherwise(""))
    plain = F.col("h.rule").isNull()
    return out.select("rec_id", F.col("h.word_idx").alias("word_idx"), "sub_idx", text.alias("text"), F.when(plain, F.col("h.start")).otherwise(F.col("h.start") + F.col("sub_idx") * span).alias("start"), F.when(plain, F.col("h.end")).otherwise(F.col("h.start") + (F.col("sub_idx") + 1) * span).alias("end"))


def captions(words: DataFrame, size: float = 72.0, most: int = 4, width: float = 900.0, gap: float = 0.45, uppercase: bool = True, glyphs: G.Glyphs = G.PLAIN) -> DataFrame:
    """(rec_id, chunk, words): captions that fit one line, of at most ``most`` words (text, start, end) each.

    Captions always break after a sentence and at a pause, so the fold that counts words and widths runs over one such
    stretch at a time, and a stretch is cut where it lies: once the words are dealt by recording, none moves again.  Without
    glyphs a character is 0.62 of the size wide.
    """
    shown = words.withColumn("shown", T.display_word("text", uppercase)).where("shown <> ''")
    w = Window.partitionBy("rec_id").orderBy("word_idx")
    forced = F.coalesce(F.lag(T.ends_caption("text")).over(w), F.lit(True)) | F.coalesce(F.col("start") - F.lag("end").over(w) >= gap, F.lit(True))
    marked = shown.withColumn("_f", forced.cast("int")).withColumn("_stretch", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    word = F.struct("word_idx", glyphs.width("shown").alias("wide"), F.col("shown").alias("text"), "start", F.greatest(F.col("end"), F.col("start") + 0.03).alias("end"))
    per = marked.groupBy("rec_id", "_stretch").agg(F.sort_array(F.collect_list(word)).alias("w"), F.first(glyphs.width(F.lit(" "))).alias("gap"))
    # as if a full caption came before the first word
    seed = F.struct(F.lit(most).alias("n"), F.lit(0).cast("long").alias("wide"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(s: Column, x: Column) -> Column:
        line = s["wide"] + F.col("gap") + x["wide"]
        full = (s["n"] >= most) | (line > glyphs.units(width, size))
        return F.struct(F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, x["wide"]).otherwise(line).alias("wide"), (s["at"] + 1).alias("at"), F.when(full, F.concat(s["begins"], F.array(s["at"]))).otherwise(s["begins"]).alias("begins"))

    edges = F.concat(F.aggregate("w", seed, step)["begins"], F.array(F.size("w")))
    cut = per.select("rec_id", "w", edges.alias("_e")).select("rec_id", "w", F.posexplode(F.slice("_e", F.lit(2), F.size("_e"))).alias("_i", "_to"), "_e")
    cut = cut.select("rec_id", F.slice("w", F.get("_e", "_i") + 1, F.col("_to") - F.get("_e", "_i")).alias("w"))
    chunk = (F.row_number().over(Window.partitionBy("rec_id").orderBy(F.element_at("w", 1)["word_idx"])) - 1).cast("long")
    return cut.select("rec_id", chunk.alias("chunk"), F.arrays_zip(F.col("w.text").alias("text"), F.col("w.start").alias("start"), F.col("w.end").alias("end")).alias("words"))


def caption_chunks(words: DataFrame, size: float = 72.0, most: int = 4, width: float = 900.0, gap: float = 0.45, uppercase: bool = True, glyphs: G.Glyphs = G.PLAIN) -> DataFrame:
    """(rec_id, chunk, pos, text, start, end): the words of captions()."""
    return captions(words, size, most, width, gap, uppercase, glyphs).select("rec_id", "chunk", F.posexplode("words").alias("pos", "x")).select("rec_id", "chunk", "pos", "x.text", "x.start", "x.end")


def caption_events(chunks: DataFrame, durations: DataFrame, linger: float = 0.35) -> DataFrame:
    """(rec_id, chunk, pos, start, until, text, words): one event per word, held until the next; the last lingers."""
    per = chunks.groupBy("rec_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "start", "end"))).alias("words"))
    return held_events(per, durations, linger)


def held_events(captions: DataFrame, durations: DataFrame, linger: float = 0.35) -> DataFrame:
    """caption_events() of whole captions (rec_id, chunk, words), whose words (text, start, end) may bear places (pos) of their own."""
    starts = F.col("words.start")
    x = captions.select("rec_id", "chunk", "words", F.array_min(starts).alias("c_start"), F.element_at("words", -1)["end"].alias("c_end")).join(durations, "rec_id")
    x = x.withColumn("following", F.coalesce(F.lead("c_start").over(Window.partitionBy("rec_id").orderBy("chunk")), F.col("duration")))
    stop = F.when(F.col("following") - F.col("c_end") < 0.12, F.col("following")).otherwise(F.least(F.col("following"), F.greatest(F.col("c_end"), F.col("c_start") + 0.25) + linger))
    own = "pos" in captions.schema["words"].dataType.elementType.names
    # what a caption's words share is worked out before they part
    x = x.select("rec_id", "chunk", stop.alias("_stop"), F.col("words.text").alias("words"), starts.alias("_starts"), *([F.col("words.pos").alias("_places")] if own else []))
    x = x.select("*", F.posexplode("_starts").alias("_i", "start"))
    place = F.get("_places", F.col("_i")) if own else F.col("_i")
    until = F.coalesce(F.get("_starts", F.col("_i") + 1), F.col("_stop"))
    return x.select("rec_id", "chunk", place.alias("pos"), "start", until.alias("until"), F.get("words", F.col("_i")).alias("text"), "words").where(F.col("until") - F.col("start") >= 0.02)
