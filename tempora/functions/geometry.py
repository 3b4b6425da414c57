"""Windows in a source picture for a 1080 x 1920 clip; all sizes in source pixels, rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these sizes.
OUT_W, OUT_H, SPLIT_TOP, CAM_FACE_SHARE = 1080, 1920, 656, 0.20


def _i(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def even(value: Column) -> Column:
    return F.greatest(F.lit(2), _i(value / 2) * 2)


def box(w: Column, h: Column, x: Column, y: Column) -> Column:
    return F.struct(w.alias("w"), h.alias("h"), x.alias("x"), y.alias("y"))


def within(value: Column, most: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), most)


def crop_box(cx: Column, cy: Column, face: Column, width: Column, height: Column) -> Column:
    """A 9:16 window on the person, tightened up to twofold around a small face; face and cy may be null."""
    full = F.least(width.cast("double"), height * OUT_W / OUT_H)
    wanted = 5.0 * face * width
    w = even(F.when((face > 0) & (wanted < 0.85 * full), F.greatest(wanted, full / 2, F.least(full, F.lit(400.0)))).otherwise(full))
    h = even(F.least(height.cast("double"), w * OUT_H / OUT_W))
    x = _i(within(F.coalesce(cx, F.lit(0.5)) * width - w / 2, (width - w).cast("double")))
    y = F.when((h < height) & (cy > 0), _i(within(cy * height - 0.38 * h, (height - h).cast("double")))).otherwise(_i((height - h) / 2))
    return box(w, h, x, y)


def stack_boxes(top: Column, bottom: Column, width: Column, height: Column) -> Column:
    """struct(top, bottom) of windows for two people one above the other; people are struct(cx, cy, w)."""
    shape = OUT_W / (OUT_H / 2)
    left, right = F.least(top["cx"], bottom["cx"]), F.greatest(top["cx"], bottom["cx"])
    face = F.greatest(top["w"], bottom["w"]) * width
    widest = F.least(F.abs(right - left) * width * 1.15, width.cast("double"), height * shape)
    centred = 2 * F.least(left, 1 - right) * width
    w = F.least(4.0 * face, centred, widest)
    w = even(F.greatest(w, F.least(3.0 * face, widest), F.least(widest, F.lit(400.0))))
    h = even(F.least(height.cast("double"), w / shape))
    at = lambda p, anchor: box(w, h, _i(within(p["cx"] * width - w / 2, (width - w).cast("double"))), _i(within(p["cy"] * height - anchor * h, (height - h).cast("double"))))
    return F.struct(at(top, 0.62).alias("top"), at(bottom, 0.42).alias("bottom"))


def split_boxes(cx: Column, cy: Column, face: Column, width: Column, height: Column) -> Column:
    """struct(cam, game): the camera's window, and that of the game, nudged away from it."""
    shape = OUT_W / SPLIT_TOP
    w = even(F.least(F.greatest(face * width / CAM_FACE_SHARE, F.lit(160.0)), width.cast("double"), height * shape))
    h = even(F.least(height.cast("double"), w / shape))
    x = within(cx * width - w / 2, (width - w).cast("double"))
    y = within(cy * height - 0.44 * h, (height - h).cast("double"))
    low = OUT_H - SPLIT_TOP
    gw = even(F.least(width.cast("double"), height * OUT_W / low))
    gh = even(F.least(height.cast("double"), gw * low / OUT_W))
    gx, room = (width - gw) / 2, 0.06 * width
    right = gx + F.least(F.greatest((x + w) - gx, F.lit(0.0)), room, width - gw - gx)
    left = gx - F.least(F.greatest((gx + gw) - x, F.lit(0.0)), room, gx)
    moved = F.when(x + w / 2 < width / 2, right).otherwise(left)
    return F.struct(box(w, h, _i(x), _i(y)).alias("cam"), box(gw, gh, _i(moved), _i((height - gh) / 2)).alias("game"))


def fit_box(cx: Column, cy: Column, face: Column, width: Column, height: Column) -> Column:
    """The whole frame, or a 4:5 window around one person where a face is given."""
    narrowest = F.least(width.cast("double"), height * OUT_W / OUT_H)
    w = even(F.least(width.cast("double"), F.greatest(face * width / 0.28, narrowest)))
    h = even(F.least(height.cast("double"), w * 1.25))
    x = _i(within(cx * width - w / 2, (width - w).cast("double")))
    y = _i(within(F.coalesce(cy, F.lit(0.5)) * height - 0.42 * h, (height - h).cast("double")))
    zero = F.lit(0)
    return F.when(face > 0, box(w, h, x, y)).otherwise(box(width.cast("int"), height.cast("int"), zero, zero))


def fit_band(fitted: Column) -> Column:
    """struct(top, bottom) of a fit_box in the output frame."""
    inner = OUT_W * fitted["h"] / fitted["w"]
    return F.struct(((OUT_H - inner) / 2).alias("top"), ((OUT_H + inner) / 2).alias("bottom"))


def head_top(kind: Column, person: Column, fitted: Column, height: Column) -> Column:
    """Where the top of the (upper) person's head lands in the output; fitted is the window that shows them.  Null where nobody is followed.

    person is struct(cx, cy, w, h); without h it is 1.2 of the width.
    """
    out_h = F.when(kind == "stack", OUT_H // 2).otherwise(OUT_H)
    hairline = (person["cy"] - 0.85 * F.coalesce(person["h"], person["w"] * 1.2)) * height
    seen = (kind == "stack") | ((kind == "crop") & (person["h"] > 0))
    return F.when(seen, F.greatest(F.lit(0.0), (hairline - fitted["y"]) * out_h / fitted["h"]))


def layout_graph(kind: Column, first: Column, second: Column, inner: Column, whole: Column, tag: Column) -> Column:
    """The filter graph from one picture to a 1080 x 1920 frame.  first and second are windows (second for two pictures only),
    inner the height of a fitted picture, whole whether it is all of the frame.  Fixed values: an encoder reads these texts.
    """
    crop = lambda b: F.format_string("crop=%d:%d:%d:%d", b["w"], b["h"], b["x"], b["y"])
    t = lambda s: F.concat(F.lit("["), tag, F.lit(f"{s}]"))
    split = F.concat(F.lit("split=2"), t("a"), t("b"), F.lit(";"))

    def two(top: int, bottom: int) -> Column:
        return F.concat(split, t("a"), crop(first), F.lit(f",scale={OUT_W}:{top}:flags=bicubic"), t("t"), F.lit(";"), t("b"), crop(second), F.lit(f",scale={OUT_W}:{bottom}:flags=bicubic"), t("u"), F.lit(";"), t("t"), t("u"), F.lit("vstack=inputs=2,setsar=1"))

    blurred = F.lit(f"scale={OUT_W // 4}:{OUT_H // 4}:force_original_aspect_ratio=increase,crop={OUT_W // 4}:{OUT_H // 4},boxblur=10:2,scale={OUT_W}:{OUT_H}:flags=bilinear,eq=brightness=-0.12:saturation=0.9")
    fit = F.concat(
        F.when(whole, "").otherwise(F.concat(crop(first), F.lit(","))), split, t("a"), blurred, t("g"), F.lit(";"), t("b"),
        F.format_string(f"scale={OUT_W}:%d:flags=bicubic", inner), t("f"), F.lit(";"), t("g"), t("f"), F.lit("overlay=(W-w)/2:(H-h)/2,setsar=1"),
    )
    return F.when(kind == "crop", F.concat(crop(first), F.lit(f",scale={OUT_W}:{OUT_H}:flags=bicubic,setsar=1"))).when(kind == "stack", two(OUT_H // 2, OUT_H // 2)).when(kind == "split", two(SPLIT_TOP, OUT_H - SPLIT_TOP)).otherwise(fit)
