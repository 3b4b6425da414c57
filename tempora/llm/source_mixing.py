"""Mixing sources to target weights: Efraimidis-Spirakis order within a source, filled up to a budget of words.

Every step is a DataFrame operation.  Sources share the words of all documents by weight, none beyond ``most`` times its own;
a source's budget pays whole epochs first, and what is left of it goes to its documents in the order of exponential keys.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import cut, parallelism, prepare, reads, release

WORD = r"[^\x20\x09-\x0D]+"
SIGNS = r"[\x21-\x40\x5B-\x60\x7B-\x7E]+"  # ASCII digits, punctuation and symbols


def plainness(text: Column) -> Column:
    """Weight of a text between 0.01 and 1: the square of its share of characters that are no ASCII digits, punctuation or symbols.

    Null and empty texts weigh 0.01.
    """
    share = F.length(F.regexp_replace(text, SIGNS, "")) / F.nullif(F.length(text), F.lit(0))
    return F.greatest(F.lit(0.01), F.coalesce(share * share, F.lit(0.0)))


def exponential_key(identity: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight for a u in (0, 1) drawn by a hash of the identity: the smaller, the earlier, and the same on every run."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), identity)), 1, 13), 16, 10).cast("long")
    return -F.log((drawn + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with ``_range``, its rows dealt out by ranges of the columns and written: equal rows, ordered last by a number, part too."""
    return cut(df.repartitionByRange(parallelism(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranged")


def running(dealt: DataFrame, by: list[str], order: list[str], values: list[str], facts: DataFrame | None = None) -> DataFrame:
    """``<value>_before``: the sum of each value over the earlier rows of the group, for what ranged() has dealt by ``by + order``.

    A group of any size is summed range by range; only one row for each range and group is ordered across ranges.  ``facts`` are
    columns of groups; they come with those rows, so that no large group is joined by its key.
    """
    across = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range", *by).agg(*[F.sum(v).alias(v) for v in values])
    starts = sums.select("_range", *by, *[F.coalesce(F.sum(v).over(across), F.lit(0)).alias(f"_start_{v}") for v in values])
    if facts is not None:
        starts = starts.join(facts, by)
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    more = [F.col(c) for c in (facts.columns if facts is not None else []) if c not in by]
    return dealt.join(starts, ["_range", *by]).select(*[F.col(c) for c in dealt.columns if c != "_range"], *more, *[(F.col(f"_start_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(f"{v}_before") for v in values])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source_key, source_size, target, budget) from (source_key, source_size): shares of all words by weight, at most ``most`` sizes each.

    Sources take the weights in turn by their keys.  What stands above the bound is shared again by weight until none is above:
    in the order of bound / weight those that are full come first, so two running sums find them.  Integers are exact; budget
    is the target rounded down.
    """
    unit = lcm(*weights)
    named = ranged(sizes.withColumn("one", F.lit(1).cast("long")), ["source_key"])
    numbered = running(named, [], ["source_key"], ["one"])
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    full = F.col("source_size") * most
    levels = ranged(numbered.select("source_key", "source_size", weight.alias("weight"), full.alias("bound")).withColumn("level", F.expr(f"bound * ({unit} div weight)")), ["level", "source_key"])
    words, all_weights = [F.lit(int(v or 0)).cast("long") for v in levels.agg(F.sum("source_size"), F.sum("weight")).first()]
    at = running(levels, [], ["level", "source_key"], ["bound", "weight"])
    big = lambda c, digits: c.cast(f"decimal({digits},0)")
    is_full = big(F.col("bound"), 19) * big(all_weights - F.col("weight_before"), 18) <= big(words - F.col("bound_before"), 19) * big(F.col("weight"), 18)
    marked = cut(at.select("source_key", "source_size", "weight", "bound", is_full.alias("is_full")), "mix")
    spent, rest = [F.lit(int(v or 0)).cast("long") for v in marked.agg(F.sum(F.when(F.col("is_full"), F.col("bound"))), F.sum(F.when(~F.col("is_full"), F.col("weight")))).first()]
    share = marked.withColumn("share", (words - spent) * F.col("weight")).withColumn("rest", rest)
    out = share.select(
        "source_key", "source_size",
        F.when(F.col("is_full"), F.col("bound").cast("double")).otherwise(F.col("share").cast("double") / F.nullif("rest", F.lit(0))).alias("target"),
        F.when(F.col("is_full"), F.col("bound")).otherwise(F.expr("share div nullif(rest, 0)")).alias("budget"),
    )
    done = cut(out, "targets")
    for t in (named, levels, marked):
        release(t)
    return done


def mix_sources(docs: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 13) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken of every row of docs (doc_id, text, source).

    ``size`` counts words.  A source's budget (its target rounded down) pays ``epochs`` of all its documents; the rest goes to them
    in Efraimidis-Spirakis order, drawn with ``weight`` (a column over docs, above 0; plainness of the text if none is given).  The
    document at the end of the budget gives as many of its words as are left, so that a source's ``taken`` add up to its budget
    and no document gives more than ``most`` times its size.

    Null text: size 0, taken 0.  Null source: a source of its own, after all others; the empty source is another one.  Null or
    repeated doc_id: every row is a document; rows alike in all that counts may change places.  Empty table: no rows.  A source
    without words: target 0.  Other columns are left alone and do not come along.  A source, or a document repeated, may hold
    any share of the rows: rows are ordered by ranges that split them.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    identity = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))
    sized = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b")).alias("source_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        exponential_key(identity, plainness(F.col("text")) if weight is None else weight, seed).alias("draw"),
        F.monotonically_increasing_id().alias("tie"),
    )
    rows = cut(sized, "sized")  # texts are read once; dealing by ranges looks at its rows twice
    dealt = ranged(rows, ["source_key", "draw", "doc_id", "size", "tie"])
    targets = source_targets(dealt.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, most)
    release(rows)
    placed = running(dealt, ["source_key"], ["draw", "doc_id", "size", "tie"], ["size"], targets)
    epochs = F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    out = placed.withColumn("epochs", epochs).select(
        "doc_id", F.when(F.col("source_key") != "b", F.expr("substring(source_key, 2)")).alias("source"), "size", "source_size", "target", "epochs",
        (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("size_before")))).alias("taken"),
    )
    return reads(out, dealt, targets)
