"""Widths of texts from a font's advances, and headlines broken by them.

Widths are whole numbers, hundredths of a font unit, so that sums and comparisons are exact whatever their order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.text import SPACE, _c, _right_strip


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Glyphs:
    """Advances of a font by code point in units of 1/em, null or beyond the end where it has no glyph; a glyph it lacks is 0.62 em wide.

    ``line_ratio`` is the height of a line by the em, as subtitles count sizes.
    """

    em: int = 1
    advances: Column | None = None
    line_ratio: float = 1.2

    @classmethod
    def of(cls, metrics: DataFrame, em: int, line_ratio: float = 1.2) -> Glyphs:
        """From metrics (code, units): one row for each code point at most, so their number is bounded by Unicode's."""
        rows = {r.code: r.units for r in metrics.select("code", "units").where("code >= 0 and units is not null").collect()}
        listed = ",".join(str(rows.get(i, "null")) for i in range(max(rows, default=-1) + 1))
        return cls(em, F.from_json(F.lit(f"[{listed}]"), "array<int>"), line_ratio)

    def units(self, pixels: float, size: float) -> int:
        """How many width units of a size fill so many pixels."""
        return int(pixels * 100 * self.em / size + 1e-9)

    def width(self, text: Column | str) -> Column:
        """Width of a text in width units."""
        if self.advances is None:
            return F.char_length(_c(text)).cast("long") * (62 * self.em)
        own = lambda ch: F.when(ch == "", 0).otherwise(F.coalesce(F.get(self.advances, F.ascii(ch)).cast("long") * 100, F.lit(62 * self.em).cast("long")))
        return F.aggregate(F.split(_c(text), ""), F.lit(0).cast("long"), lambda n, ch: n + own(ch))

    def pixels(self, units: Column, size: float) -> Column:
        return units * (size / (100.0 * self.em))

    def ass_size(self, size: float) -> float:
        """A size as subtitles count it."""
        return round(size * self.line_ratio, 1)


PLAIN = Glyphs()
#: More lines than any headline may have.
NEVER = 1_000_000


def wrapped_title(title: Column | str, size: float, width: float = 840.0, most: int = 3, glyphs: Glyphs = PLAIN) -> Column:
    """A headline in the fewest lines that fit, as even as can be (of equally even ones the earliest breaks); one too long for ``most``
    lines is filled line by line and cut with an ellipsis.

    Filling lines from the left tells how many a width needs; the least width that needs no more is found by halving, and lines
    filled from the right at that width break earliest.  Each is a fold over the words with one line as its state.
    """
    room = glyphs.units(width, size)
    gap = let(glyphs.width(F.lit(" ")), lambda x: x) if glyphs.advances is not None else F.lit(62 * glyphs.em).cast("long")
    words = F.transform(F.filter(F.split(_c(title), f"{SPACE}+"), lambda w: w != ""), lambda w: F.struct(w.alias("w"), glyphs.width(w).alias("n")))
    zero = F.lit(0).cast("long")

    def wrapped(of: Column, space: Column) -> Column:
        def needed(limit: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                wide = s["used"] + space + x["n"]
                fits = (s["lines"] > 0) & (wide <= limit)
                return F.struct(F.when(fits, s["lines"]).otherwise(s["lines"] + F.when(x["n"] > limit, NEVER).otherwise(1)).alias("lines"), F.when(fits, wide).otherwise(x["n"]).alias("used"))

            return F.aggregate(of, F.struct(zero.alias("lines"), zero.alias("used")), step)["lines"]

        def halve(lines: Column) -> Column:
            def step(s: Column, _: Column) -> Column:
                def choose(mid: Column) -> Column:
                    return let(needed(mid) <= lines, lambda ok: F.struct(F.when(ok, s["no"]).otherwise(mid).alias("no"), F.when(ok, mid).otherwise(s["yes"]).alias("yes")))

                return let(F.floor((s["no"] + s["yes"]) / 2), choose)

            return F.aggregate(F.sequence(F.lit(1), F.lit(room.bit_length())), F.struct(zero.alias("no"), F.lit(room).cast("long").alias("yes")), step)["yes"]

        def from_right(limit: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                wide = s["used"] + space + x["n"]
                fits = (F.size(s["lines"]) > 0) & (wide <= limit)
                grown = F.concat(F.array(F.concat(x["w"], F.lit(" "), F.get(s["lines"], F.lit(0)))), F.slice(s["lines"], 2, most))
                return F.struct(F.when(fits, grown).otherwise(F.concat(F.array(x["w"]), s["lines"])).alias("lines"), F.when(fits, wide).otherwise(x["n"]).alias("used"))

            return F.aggregate(F.reverse(of), F.struct(F.array().cast("array<string>").alias("lines"), zero.alias("used")), step)["lines"]

        def filled() -> Column:
            """The first ``most`` lines, filled from the left; a word too wide for any line has one of its own."""

            def step(s: Column, x: Column) -> Column:
                wide = s["used"] + space + x["n"]
                fits = (F.size(s["lines"]) > 0) & (wide <= room)
                last = F.concat(F.slice(s["lines"], F.lit(1), F.size(s["lines"]) - 1), F.array(F.concat(F.element_at(s["lines"], -1), F.lit(" "), x["w"])))
                now = F.struct(F.when(fits, last).otherwise(F.concat(s["lines"], F.array(x["w"]))).alias("lines"), F.when(fits, wide).otherwise(x["n"]).alias("used"))
                return F.when(F.size(s["lines"]) > most, s).otherwise(now)

            lines = F.aggregate(of, F.struct(F.array().cast("array<string>").alias("lines"), zero.alias("used")), step)["lines"]
            return let(F.slice(lines, 1, most), lambda x: F.concat(F.slice(x, F.lit(1), F.size(x) - 1), F.array(F.concat(_right_strip(F.element_at(x, -1), ".,;:"), F.lit("…")))))

        best = let(needed(F.lit(room).cast("long")), lambda lines: F.when(lines <= most, let(halve(lines), from_right)).otherwise(filled()))
        return F.when(F.size(of) == 0, F.array().cast("array<string>")).otherwise(best)

    return let(words, lambda of: let(gap, lambda space: wrapped(of, space)))
