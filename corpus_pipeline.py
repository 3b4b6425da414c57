"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, written as Parquet and read again.  All but the last return the columns
of the documents they were given; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import bloom, cut, in_bloom, prepare, read, release
from tempora.llm.language_id import predict, train
from tempora.llm.ngram_jaccard import jaccard_components
from tempora.llm.packing import pack_documents
from tempora.llm.string_tiling import flag_leaks
from tempora.llm.weak_quality import classify_quality


#: Rows of an Arrow batch, and chunks and words that packing remembers: executors that run all stages have less room for each.
ROWS, REMEMBER = 250, (30_000, 60_000)


def _inside(docs: DataFrame) -> dict[str, str]:
    """Names for the columns of docs that cannot clash with those made by operators."""
    return {c: c if c in ("text", "doc_id") else f"_{i}" for i, c in enumerate(docs.columns)}


def _filtered(docs: DataFrame, judge: Callable[[DataFrame, tuple[str, ...]], DataFrame], verdict: str) -> DataFrame:
    """The rows whose verdict is true, in one narrow pass; other columns pass under names that cannot clash with the judge's."""
    inside = _inside(docs)
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()])
    judged = judge(renamed, tuple(inside.values())).where(verdict)
    return judged.select(*[F.col(n).alias(c) for c, n in inside.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; it is trained on the labelled ones among them.

    Null and empty texts and texts without letters are rejected.  Rows are judged by their text alone, whole and of any
    length; repeated rows and rows without doc_id are rows like others; an empty table gives an empty result.
    """
    prepare(spark, ROWS)
    model = train(docs.select("doc_id", "text", "lang"))
    return _filtered(docs, lambda d, columns: predict(d, model, columns), "accepted")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained scorer accepts (a score of 0.5 does).

    Null, empty and white texts are rejected.  Rows are judged by their text alone, whole and of any length; repeated rows
    and rows without doc_id are rows like others; an empty table gives an empty result.
    """
    prepare(spark, ROWS)
    return _filtered(docs, classify_quality, "kept")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest doc_id.

    Documents go by doc_id and text: rows that repeat both are one document, of which the first by its other columns (as
    JSON) stays; unlike texts under one doc_id are documents of their own, and so are rows without doc_id, which come after
    all others of their group (ties: by a hash of the text).  Null and empty texts and texts of white space are in no
    group; of such rows only repeated ones go.  An empty table gives an empty result.
    """
    prepare(spark, ROWS)
    inside = _inside(docs)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("check"), *[F.col(f"`{c}`").alias(n) for c, n in inside.items()])
    found = jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"), k=5, percent=80)
    groups = cut(found.select(F.col("doc_id").alias("key"), "component_id"), "pipeline")
    release(found)
    others = groups.where("key <> component_id").distinct()
    members = others.unionByName(others.select(F.col("component_id").alias("key"), "component_id").distinct())
    members = members.join(keyed.select("key", "check", "doc_id").distinct(), "key")
    clash = members.groupBy("key").agg((F.min("check") != F.max("check")).alias("clash"))  # two documents under one key: both stay
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("best"))
    gone = members.join(best, "component_id").where(F.col("key") != F.col("best.key")).join(clash.where("not clash"), "key").select("key", F.lit(True).alias("gone"), F.lit(False).alias("repeated"))
    repeated = groups.groupBy("key").count().where("count > 1").select("key", F.lit(False).alias("gone"), F.lit(True).alias("repeated"))
    marks = cut(gone.unionByName(repeated).groupBy("key").agg(F.max("gone").alias("gone"), F.max("repeated").alias("repeated")), "pipeline")
    release(groups)
    # a filter of bounded size lets most rows stay where they are: only marked ones, and a few others, are shuffled
    known = spark.sparkContext.broadcast(bloom(marks, "key"))

    @F.pandas_udf("boolean")
    def marked(key: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(key.to_numpy(), *known.value))

    keyed = keyed.withColumn("marked", marked("key"))
    rest, looked = keyed.where("not marked"), keyed.where("marked").join(marks, "key", "left").where("not coalesce(gone, false)")
    names = list(inside.values())
    single = looked.where("not coalesce(repeated, false)")
    first = looked.where("repeated").groupBy("key", "check").agg(F.min_by(F.struct(*names), F.to_json(F.struct(*[n for n in names if n != "text"]))).alias("row")).select("row.*")
    kept = rest.select(names).unionByName(single.select(names)).unionByName(first.select(names))
    return kept.select(*[F.col(n).alias(c) for c, n in inside.items()])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are judged by their text alone, whole and of any length: rows without doc_id and repeated rows too.  Null and empty
    texts hold nothing and stay; an empty table gives an empty result, and an empty benchmark leaves all rows.
    """
    prepare(spark, ROWS)
    return _filtered(docs, lambda d, _: flag_leaks(d, read(spark, sf_dir, "benchmark")), "not leaked")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens.

    Null and empty texts are pieces of one token, the end; longer documents than a sequence are cut; repeated rows and rows
    without doc_id are packed each for itself; an empty table gives an empty result.
    """
    prepare(spark, ROWS)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), remember=REMEMBER)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and genetic packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = prepare(spark, ROWS).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
