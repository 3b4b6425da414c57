"""Face samples to layouts: who is prominent, whether a camera box stays put, what most samples say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.temporal import samples_in_shots

# Results depend on these limits.
MIN_SCORE, TINY, MIN_HEIGHT, CAM_MOST, TOO_CLOSE = 0.7, 0.03, 0.07, 0.20, 0.40


def significant(faces: Column) -> Column:
    """The largest face and those of at least 0.45 of its height, from left to right; none if even it is small."""
    good = F.filter(faces, lambda f: (f["score"] >= MIN_SCORE) & (f["h"] >= TINY))
    biggest = F.array_max(F.transform(good, lambda f: f["h"]))
    kept = F.filter(good, lambda f: f["h"] >= 0.45 * biggest)
    ordered = F.transform(F.array_sort(F.transform(kept, lambda f: F.struct(f["cx"].alias("k"), f.alias("f")))), lambda x: x["f"])
    return F.when(biggest >= MIN_HEIGHT, ordered).otherwise(F.filter(faces, lambda f: F.lit(False)))


def shot_bounds(cuts: DataFrame, durations: DataFrame, least: float = 0.5) -> DataFrame:
    """(rec_id, shot, start, end): a cut counts ``least`` after the last that counted and before the end."""
    per = durations.join(cuts.groupBy("rec_id").agg(F.array_sort(F.collect_list("t")).alias("c")), "rec_id", "left")
    c = F.coalesce("c", F.array().cast("array<double>"))

    def step(edges: Column, t: Column) -> Column:
        return F.when((t - F.element_at(edges, -1) >= least) & (F.col("duration") - t >= least), F.concat(edges, F.array(t))).otherwise(edges)

    edged = per.select("rec_id", F.concat(F.aggregate(c, F.array(F.lit(0.0)), step), F.array(F.col("duration").cast("double"))).alias("e"))
    shots = F.transform(F.slice("e", F.lit(1), F.size("e") - 1), lambda x, i: F.struct(x.alias("start"), F.get(F.col("e"), i + 1).alias("end")))
    return edged.select("rec_id", F.posexplode(shots).alias("shot", "s")).select("rec_id", "shot", "s.start", "s.end")


def layout_votes(samples: DataFrame) -> DataFrame:
    """(rec_id, shot, total, crowds, pairs, singles, layout) from samples (rec_id, shot, t, faces)."""
    s = samples.withColumn("n", F.size(significant(F.col("faces"))))
    votes = s.groupBy("rec_id", "shot").agg(F.count("*").alias("total"), F.count_if(F.col("n") >= 3).alias("crowds"), F.count_if(F.col("n") >= 2).alias("pairs"), F.count_if(F.col("n") >= 1).alias("singles"))
    layout = F.when(F.col("crowds") >= 0.5 * F.col("total"), "fit").when(F.col("pairs") >= 0.35 * F.col("total"), "pair").when(F.col("singles") >= 0.4 * F.col("total"), "one").otherwise("fit")
    return votes.withColumn("layout", layout)


def camera_boxes(samples: DataFrame, most: float = CAM_MOST, by: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """(rec_id, cx, cy, w, h) where samples (rec_id, t, faces) show one smallish face that stays put; medians by coordinate.

    ``by`` may add columns, as a shot.
    """
    by = list(by)
    good = F.filter("faces", lambda f: (f["score"] >= MIN_SCORE) & (f["h"] >= TINY))
    s = samples.withColumn("good", good).withColumn("top", F.array_max(F.transform("good", lambda f: F.struct(f["h"].alias("h"), f["cx"].alias("cx"), f["cy"].alias("cy"), f["w"].alias("w")))))
    alone = F.size(F.filter("good", lambda f: f["h"] >= 0.6 * F.col("top.h"))) == 1
    s = s.withColumn("crowded", F.coalesce(F.col("top.h") > most, F.lit(False))).withColumn("found", F.coalesce(~F.col("crowded") & alone & F.col("top").isNotNull(), F.lit(False)))
    facts = s.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("crowded").alias("crowded"), F.count_if("found").alias("found"))
    kept = s.where("found").join(facts.where((F.col("found") >= 0.5 * F.col("n")) & (F.col("crowded") <= 0.25 * F.col("n"))).select(*by), by, "left_semi").select(*by, "top.*")
    centre = kept.groupBy(*by).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("cx", "cy", "w", "h")])
    steady = kept.select(*by, F.col("cx").alias("x"), F.col("cy").alias("y")).join(centre, by).groupBy(*by, "cx", "cy", "w", "h").agg(F.count("*").alias("n"), F.count_if((F.abs(F.col("x") - F.col("cx")) < 0.05) & (F.abs(F.col("y") - F.col("cy")) < 0.06)).alias("steady"))
    return steady.where(F.col("steady") >= 0.8 * F.col("n")).select(*by, "cx", "cy", "w", "h")


def median_pairs(samples: DataFrame) -> DataFrame:
    """(rec_id, shot, left, right): medians by coordinate of the two largest faces of samples (rec_id, shot, t, faces), by their side."""
    by_size = F.slice(F.array_sort(F.transform("faces", lambda f, i: F.struct((-f["h"]).alias("k"), i.alias("i"), f.alias("f")))), 1, 2)
    sides = F.array_sort(F.transform(by_size, lambda x, i: F.struct(x["f"]["cx"].alias("k"), i.alias("i"), x["f"].alias("f"))))
    x = samples.where(F.size("faces") >= 2).withColumn("_l", F.element_at(sides, 1)["f"]).withColumn("_r", F.element_at(sides, 2)["f"])
    middle = lambda side: F.struct(*[F.percentile(f"{side}.{c}", F.lit(0.5)).alias(c) for c in ("cx", "cy", "w", "h")])
    return x.groupBy("rec_id", "shot").agg(middle("_l").alias("left"), middle("_r").alias("right"))


def followed(samples: DataFrame, window: float, least: float = 0.5) -> DataFrame:
    """(rec_id, shot, start, end, cx, cy, w, h): where one person sits, in one or two places, from samples (rec_id, shot, t, t0, t1, face).

    Two places if a gap of a quarter of the window parts a fifth of the samples; single blips are ignored, and a place is
    left only ``least`` seconds after it was taken.  A fold over the samples of one shot.
    """
    per = samples.groupBy("rec_id", "shot", "t0", "t1").agg(F.array_sort(F.collect_list(F.struct("t", "face"))).alias("s"))
    xs = F.array_sort(F.transform("s", lambda p: p["face"]["cx"]))
    per = per.withColumn("xs", xs).withColumn("n", F.size("s"))
    gaps = F.transform(F.slice("xs", F.lit(1), F.col("n") - 1), lambda x, i: F.struct((F.get(F.col("xs"), i + 1) - x).alias("gap"), i.alias("at"), ((F.get(F.col("xs"), i + 1) + x) / 2).alias("middle")))
    per = per.withColumn("g", F.array_max(F.when(F.col("n") > 1, gaps)))
    wide = F.element_at("xs", -1) - F.element_at("xs", 1) >= 0.5 * window
    two = wide & (F.col("g.gap") >= 0.25 * window) & (F.least(F.col("g.at") + 1, F.col("n") - F.col("g.at") - 1) >= 0.2 * F.col("n"))
    per = per.withColumn("two", F.coalesce(two, F.lit(False))).withColumn("raw", F.transform("s", lambda p: p["face"]["cx"] > F.col("g.middle")))
    seed = F.array().cast("array<boolean>")

    def calm(out: Column, i: Column) -> Column:
        x, last, after = F.get("raw", i), F.try_element_at(out, F.lit(-1)), F.get("raw", i + 1)
        blip = (i > 0) & (i < F.col("n") - 1) & (x != last) & (x != after)
        return F.concat(out, F.array(F.when(blip, last).otherwise(x)))

    per = per.withColumn("side", F.when(F.col("two"), F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), seed, calm)).otherwise(F.transform("s", lambda p: F.lit(False))))
    start = F.struct(F.col("t0").cast("double").alias("begin"), F.array().cast("array<struct<start:double,end:double,side:boolean>>").alias("out"))

    def switch(state: Column, i: Column) -> Column:
        now, last = F.get("side", i), F.get("side", i - 1)
        at = (F.get("s", i)["t"] + F.get("s", i - 1)["t"]) / 2
        ok = (now != last) & (at - state["begin"] >= least) & (F.col("t1") - at >= least)
        row = F.array(F.struct(state["begin"].alias("start"), at.alias("end"), last.alias("side")))
        return F.struct(F.when(ok, at).otherwise(state["begin"]).alias("begin"), F.when(ok, F.concat(state["out"], row)).otherwise(state["out"]).alias("out"))

    steps = F.when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    per = per.withColumn("f", F.aggregate(steps, start, switch))
    rows = F.concat("f.out", F.array(F.struct(F.col("f.begin").alias("start"), F.col("t1").cast("double").alias("end"), F.element_at("side", -1).alias("side"))))
    pieces = per.select("rec_id", "shot", F.explode(rows).alias("p")).select("rec_id", "shot", "p.start", "p.end", "p.side")
    spots = per.select("rec_id", "shot", F.explode(F.arrays_zip("s", "side")).alias("z")).groupBy("rec_id", "shot", F.col("z.side").alias("side"))
    spots = spots.agg(*[F.percentile(f"z.s.face.{c}", F.lit(0.5)).alias(c) for c in ("cx", "cy", "w", "h")])
    return pieces.join(spots, ["rec_id", "shot", "side"]).select("rec_id", "shot", "start", "end", "cx", "cy", "w", "h")


#: The framing of a segment: the person (or camera, or upper person) and the lower person.
PERSON = "struct<cx:double,cy:double,w:double,h:double>"


def planned_shots(samples: DataFrame, shots: DataFrame, window: float, layout: str = "auto") -> DataFrame:
    """(rec_id, shot, start, end, kind, person, below): how each shot (rec_id, shot, start, end) is shown, from samples (rec_id, t, faces).

    ``window`` is the width of a 9:16 crop as a share of the frame; layout is auto, crop, stack or fit.  Votes of the samples
    decide between the whole picture, one window over two people, two windows, and a window that follows one person.
    """
    none = F.lit(None).cast(PERSON)
    person = lambda c: F.struct(c["cx"].alias("cx"), c["cy"].alias("cy"), c["w"].alias("w"), c["h"].alias("h")).cast(PERSON)
    only = lambda cx: F.struct(cx.alias("cx"), F.lit(None).alias("cy"), F.lit(None).alias("w"), F.lit(None).alias("h")).cast(PERSON)
    if layout == "fit":
        return shots.select("rec_id", "shot", "start", "end", F.lit("fit").alias("kind"), none.alias("person"), none.alias("below"))
    inside = samples_in_shots(samples, shots).withColumn("faces", significant(F.col("faces")))
    votes = inside.groupBy("rec_id", "shot").agg(F.count("*").alias("total"), F.count_if(F.size("faces") >= 3).alias("crowds"), F.count_if(F.size("faces") >= 2).alias("pairs"), F.count_if(F.size("faces") >= 1).alias("singles"))
    v = shots.join(votes, ["rec_id", "shot"], "left").join(median_pairs(inside), ["rec_id", "shot"], "left")
    crowd = (F.col("crowds") >= 0.5 * F.col("total")) & F.lit(layout != "crop")
    choice = F.when(F.col("total").isNull(), "none").when(crowd, "fit").when(F.col("pairs") >= 0.35 * F.col("total"), "pair").when(F.col("singles") >= 0.4 * F.col("total"), "one").otherwise("none")
    v = v.withColumn("choice", choice)
    l, r = F.col("left"), F.col("right")
    fits = (r["cx"] + r["w"] * 0.9) - (l["cx"] - l["w"] * 0.9) <= window
    one = F.lit(layout == "crop") | (fits & F.lit(layout != "stack"))
    middle = F.when(fits, (l["cx"] + r["cx"]) / 2).otherwise(F.when(r["h"] > l["h"], r["cx"]).otherwise(l["cx"]))
    shown = v.where("choice <> 'one'")
    alone = (F.col("choice") == "none") & F.lit(layout == "crop")
    kind = F.when(F.col("choice") == "pair", F.when(one, "crop").otherwise("stack")).when(alone, "crop").otherwise("fit")
    upper = F.when(F.col("choice") == "pair", F.when(one, only(middle)).otherwise(person(l))).when(alone, only(F.lit(0.5)))
    whole = shown.select("rec_id", "shot", "start", "end", kind.alias("kind"), upper.alias("person"), F.when((F.col("choice") == "pair") & ~one, person(r)).alias("below"))
    largest = F.element_at(F.array_sort(F.transform("faces", lambda f, i: F.struct((-f["h"]).alias("k"), i.alias("i"), f.alias("f")))), 1)["f"]
    singles = inside.where(F.size("faces") >= 1).join(v.where("choice = 'one'").select("rec_id", "shot"), ["rec_id", "shot"], "left_semi").select("rec_id", "shot", "t", "t0", "t1", person(largest).alias("face"))
    one_by_one = followed(singles, window).select("rec_id", "shot", "start", "end", F.lit("crop").alias("kind"), F.struct("cx", "cy", "w", "h").cast(PERSON).alias("person"), none.alias("below"))
    return whole.unionByName(one_by_one)


def stabilized(segments: DataFrame) -> DataFrame:
    """Segments (rec_id, start, end, kind, person, below) with the framing of the first like them, and equal neighbours as one.

    Alike: crops within 0.04 of the width, stacks with both people so, cameras also within 0.05 of the height.  A fold over the few
    segments of one recording.
    """
    one = "struct<start:double,end:double,kind:string,person:" + PERSON + ",below:" + PERSON + ">"
    per = segments.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "person", "below").cast(one))).alias("s"))
    seed = F.struct(F.array().cast(f"array<{one}>").alias("seen"), F.array().cast(f"array<{one}>").alias("out"))
    near = lambda x, y, name, most: F.abs(x[name]["cx"] - y[name]["cx"]) < most

    def alike(a: Column, b: Column) -> Column:
        level = F.abs(a["person"]["cy"] - b["person"]["cy"]) < 0.05
        same = F.when(a["kind"] == "split", near(a, b, "person", 0.04) & level).when(a["kind"] == "stack", near(a, b, "person", 0.04) & near(a, b, "below", 0.04)).otherwise(near(a, b, "person", 0.04))
        return (a["kind"] == b["kind"]) & F.coalesce(same, F.lit(False))

    def step(state: Column, x: Column) -> Column:
        match = F.when(x["kind"] != "fit", F.try_element_at(F.filter(state["seen"], lambda y: alike(y, x)), F.lit(1)))
        row = lambda start, end, kind, person, below: F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"), person.alias("person"), below.alias("below")).cast(one)
        shown = F.when(match.isNotNull(), row(x["start"], x["end"], x["kind"], match["person"], match["below"])).otherwise(x)
        seen = F.when((x["kind"] == "fit") | match.isNotNull(), state["seen"]).otherwise(F.concat(state["seen"], F.array(x)))
        last = F.try_element_at(state["out"], F.lit(-1))
        same = last.isNotNull() & (last["kind"] == shown["kind"]) & last["person"].eqNullSafe(shown["person"]) & last["below"].eqNullSafe(shown["below"])
        longer = F.concat(F.slice(state["out"], F.lit(1), F.size(state["out"]) - 1), F.array(row(last["start"], shown["end"], last["kind"], last["person"], last["below"])))
        return F.struct(seen.alias("seen"), F.when(same, longer).otherwise(F.concat(state["out"], F.array(shown))).alias("out"))

    return per.select("rec_id", F.explode(F.aggregate("s", seed, step)["out"]).alias("x")).select("rec_id", "x.*")


def planned(samples: DataFrame, cuts: DataFrame, durations: DataFrame, window: float, layout: str = "auto", stream: bool = False) -> DataFrame:
    """(rec_id, start, end, kind, person, below): layouts from start to end of recordings (rec_id, duration).

    kind is crop, stack, split or fit.  On streams a camera box that is there for most of the recording decides for all of it,
    and one that is there for a shot decides for that; other small faces are nobody to zoom in on.  Somebody who would fill
    the window from edge to edge is shown in a fitted picture.
    """
    none = F.lit(None).cast(PERSON)
    whole = durations.select("rec_id", F.lit(0.0).alias("start"), F.col("duration").cast("double").alias("end"))
    fitted = lambda d: d.select("rec_id", "start", "end", F.lit("fit").alias("kind"), none.alias("person"), none.alias("below"))
    camera = F.struct("cx", "cy", "w", "h").cast(PERSON).alias("person")
    if layout == "fit":
        return fitted(whole)
    shots, out = shot_bounds(cuts, durations), None
    on_stream = stream and layout == "auto"
    if layout == "split" or on_stream:
        cams = camera_boxes(samples, CAM_MOST if layout == "auto" else 1.0)
        out = whole.join(cams, "rec_id").select("rec_id", "start", "end", F.lit("split").alias("kind"), camera, none.alias("below"))
        if layout == "split":
            return out.unionByName(fitted(whole.join(cams.select("rec_id"), "rec_id", "left_anti")))
        shots = shots.join(cams.select("rec_id"), "rec_id", "left_anti")
    columns, by_shot = ["rec_id", "start", "end", "kind", "person", "below"], None
    if on_stream:
        cams = camera_boxes(samples_in_shots(samples, shots).select("rec_id", "shot", "t", "faces"), CAM_MOST, ("rec_id", "shot"))
        by_shot = shots.join(cams, ["rec_id", "shot"]).select("rec_id", "start", "end", F.lit("split").alias("kind"), camera, none.alias("below"))
        shots = shots.join(cams.select("rec_id", "shot"), ["rec_id", "shot"], "left_anti")
        # those prominent beside the largest are told before small ones go
        samples = samples.withColumn("faces", F.filter(significant(F.col("faces")), lambda f: f["h"] > CAM_MOST))
    planned_ = planned_shots(samples, shots, window, layout).select(columns)
    steady = stabilized(planned_ if by_shot is None else planned_.unionByName(by_shot))
    if layout == "auto":
        close = (F.col("kind") == "crop") & F.coalesce(F.col("person.w") > TOO_CLOSE * window, F.lit(False))
        steady = steady.withColumn("kind", F.when(close, "fit").otherwise(F.col("kind")))
    return steady.select(columns) if out is None else out.unionByName(steady.select(columns))


def dominant_layout(pieces: DataFrame) -> DataFrame:
    """(rec_id, kind, frames, kinds): the kind with the most frames (of equal ones the first), and all kinds joined by +."""
    per = pieces.groupBy("rec_id", "kind").agg(F.sum(F.col("last") - F.col("first")).alias("frames"), F.min("first").alias("seen"))
    return per.groupBy("rec_id").agg(F.max_by("kind", F.struct("frames", -F.col("seen"))).alias("kind"), F.max("frames").alias("frames"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"))


def text_places(pieces: DataFrame) -> DataFrame:
    """(rec_id, caption_y, title_y, floor): where captions and headline go, from pieces (rec_id, first, last, kind, head, band).

    head is where the head of the person that a piece follows begins in the output (null: nobody), band struct(top, bottom)
    of its fitted picture; floor is the lowest that the headline may reach (null: no limit).  Fixed values: places in pixels.
    """
    frames = F.col("last") - F.col("first")
    per_kind = pieces.groupBy("rec_id", "kind").agg(F.sum(frames).alias("n"), F.min("first").alias("seen"))
    facts = per_kind.groupBy("rec_id").agg(F.max_by("kind", F.struct("n", -F.col("seen"))).alias("most"), F.bool_or(F.col("kind") == "stack").alias("stacked"))
    longest = F.max_by(F.when(F.col("kind") == "fit", F.col("band")), F.when(F.col("kind") == "fit", F.struct(frames, -F.col("first"))))
    opening = pieces.groupBy("rec_id").agg(F.min_by(F.struct("kind", "head", "band"), "first").alias("open"), longest.alias("band"))
    x = facts.join(opening, "rec_id")
    head = F.when(F.col("open.head").isNotNull(), F.col("open.head") - 24)
    fit_caption = F.least(F.greatest(F.col("band.bottom") + 150, F.lit(1920 * 0.66)), F.lit(1920 * 0.775)).cast("int")
    fit_title = F.greatest(F.least(F.col("band.top") - 150, F.lit(1920 * 0.17)), F.lit(1920 * 0.115)).cast("int")
    split, stack, fit = F.col("most") == "split", F.col("stacked"), F.col("most") == "fit"
    caption = F.when(split, 656 + 140).when(stack, 960).when(fit, fit_caption).otherwise(int(1920 * 0.66))
    title = F.when(split, 656 - 60).when(stack, 200).when(fit, fit_title).otherwise(int(1920 * 0.165))
    floor = F.when(split, F.lit(None)).when(stack, head).when(fit & (F.col("open.kind") == "fit"), F.col("open.band.top") - 24).otherwise(head)
    return x.select("rec_id", caption.alias("caption_y"), title.alias("title_y"), floor.cast("double").alias("floor"))
