"""Operator 7: language identification by averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams (1 to 4, lower case, digits and signs folded);
a linear softmax without bias gives the languages, so n-grams never seen leave the text near the uniform score.  Both
layers are trained by stochastic gradient descent in numpy, on whole texts and on short pieces of them, from a bounded
sample of labelled rows.  A temperature is fitted on held-back rows, and the score below which a prediction is
rejected is set there too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import mix64, prepare, slices, tidy

BUCKETS, DIMENSION, LONGEST = 1 << 18, 12, 4
#: Labelled rows to learn from for each language, bytes of all of them together, and bytes of one: longer texts are not among them.
SAMPLE, SAMPLE_BYTES, ROW_BYTES = 1500, 64 << 20, 200_000
#: Languages of the sample at most, those with the most rows: more than there are.
MOST_LANGUAGES = 8192
UNKNOWN = "und"


def folded(text: str) -> np.ndarray:
    """Code points in lower case; runs of anything but letters are one space."""
    from tempora.llm.token_counts import LETTER, character_classes

    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = character_classes()[points] == LETTER
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    return points[keep]


def narrow(points: np.ndarray) -> np.ndarray:
    """The same code points in half the room, where none is beyond 16 bits."""
    return points.astype(np.uint16) if points.max(initial=0) < 1 << 16 else points


def grams(points: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of folded code points."""
    out, points = [], points.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(points) < n:
                break
            h = h[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
            out.append((mix64(h) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


@dataclass
class LanguageModel:
    """Languages, the table of each bucket, the softmax over it, the temperature and the score to accept from.

    The table holds embeddings, or with fewer languages than they have numbers, their products with the softmax, which is
    then no more needed: a mean of products is the product of the mean.
    """

    languages: list[str]
    table: np.ndarray
    softmax: np.ndarray | None
    temperature: float
    accept: float

    def logits(self, points: np.ndarray) -> np.ndarray:
        z = self.table[grams(points)].mean(0, dtype=np.float64)
        return z if self.softmax is None else z @ self.softmax

    def probabilities(self, text: str) -> np.ndarray:
        z = self.logits(folded(text)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def fit(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 2.0, seed: int = 5, errors: float = 0.005) -> LanguageModel:
    """Train on (text, language) rows; a fifth is held back to calibrate."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    data = [(narrow(folded(t)), number[lang]) for t, lang in rows]
    data = [(p, y) for p, y in data if (p != 32).any()]
    order = rng.permutation(len(data))
    held, learn = order[: len(data) // 5], order[len(data) // 5 :]
    e = rng.normal(0, 0.01, (BUCKETS, DIMENSION))
    w = rng.normal(0, 0.5, (DIMENSION, max(len(languages), 1)))
    steps, done = epochs * len(learn), 0

    def piece(p: np.ndarray) -> np.ndarray:
        """The whole text, or every other time a short piece of it."""
        if rng.random() < 0.5 or len(p) < 20:
            return p
        n = int(rng.integers(10, 160))
        at = int(rng.integers(0, max(1, len(p) - n)))
        return p[at : at + n]

    for _ in range(epochs):
        for i in rng.permutation(learn):
            p, y = data[i]
            ids, n = np.unique(grams(piece(p)), return_counts=True)
            share = n / n.sum()
            v = share @ e[ids]
            z = v @ w
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            step = rate * (1 - done / steps)
            back = w @ g
            # each layer's step is divided by what the other multiplies it by, so no step overshoots
            along = step / (1 + (w * w).sum()) / max(share @ share, 1 / 200)
            w -= step / (1 + v @ v) * np.outer(v, g)
            e[ids] -= along * share[:, None] * back
            done += 1
    seen = np.zeros(BUCKETS, bool)
    for i in learn:
        seen[grams(data[i][0])] = True
    e[~seen] = 0
    model = LanguageModel(languages, (e @ w).astype(np.float32), None, 1.0, 0.0) if len(languages) <= DIMENSION else LanguageModel(languages, e.astype(np.float32), w, 1.0, 0.0)
    z = np.array([model.logits(data[i][0]) for i in held]).reshape(len(held), w.shape[1])
    y = np.array([data[i][1] for i in held], int)

    def at(t: float) -> np.ndarray:
        q = np.exp((z - z.max(1, keepdims=True)) / t)
        return q / q.sum(1, keepdims=True)

    grid = np.geomspace(0.5, 20, 41)  # few held-back texts, all right, must not make it sure of everything
    temperature = float(min(grid, key=lambda t: -np.log(np.maximum(at(t)[np.arange(len(y)), y], 1e-12)).mean())) if len(y) else 1.0
    q = at(temperature) if len(y) else np.zeros((0, 1))
    right, score = q.argmax(1) == y, q.max(1) if len(y) else np.zeros(0)
    floor = 1.5 / max(len(languages), 1) if len(languages) > 1 else 0.0  # what says next to nothing
    # the lowest score from which no more predictions are wrong than chance explains, but none that costs many right ones
    most = np.quantile(score[right], 0.001) if right.any() else 0.0
    chance = lambda n: errors * n + 2 * np.sqrt(errors * n) + 1
    accept = next((s for s in (floor, *np.sort(score[score > floor])) if (~right[score >= s]).sum() <= chance((score >= s).sum())), floor)
    model.temperature, model.accept = temperature, float(max(floor, min(accept, most)))
    return model


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, sample: int = SAMPLE, most_languages: int = MOST_LANGUAGES, sample_bytes: int = SAMPLE_BYTES, row_bytes: int = ROW_BYTES) -> LanguageModel:
    """Learn from docs (doc_id, text, lang), none of the held-out fold (crc32 of doc_id mod 4 is 2).

    The bounds of the sample, all of labelled rows: about ``sample`` rows of each language, and an equal share of about ``sample_bytes``
    of text; the ``most_languages`` languages with the most rows.  Rows are chosen by a hash of doc_id and text (copies under
    one id count once, with the first of their languages by name) and learned from whole, in the order of that hash, so how
    files and partitions lie changes nothing.  Texts of more than ``row_bytes`` are not chosen, unless a language has no other.
    """
    usable = docs.where((fold_of(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & (F.col("text") != "")).withColumn("_b", F.octet_length("text"))
    short = F.col("_b") <= row_bytes
    sums = [F.count("*").alias("n"), F.sum("_b").alias("bytes"), F.sum(F.when(short, 1).otherwise(0)).alias("n_short"), F.sum(F.when(short, F.col("_b")).otherwise(0)).alias("bytes_short")]
    top = usable.groupBy("lang").agg(*sums).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not top:
        return fit([])
    room = sample_bytes / len(top)
    share = lambda r: min(1.0, sample / (r["n_short"] or r["n"]), room / (r["bytes_short"] or r["bytes"]))
    known = docs.sparkSession.createDataFrame([(r["lang"], int(share(r) * (1 << 40)), row_bytes if r["n_short"] else 1 << 62) for r in top], "lang string, _share long, _most long")
    hashed = usable.withColumn("_h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))).join(F.broadcast(known), "lang")  # a row for each language of the sample
    chosen = hashed.where((F.col("_h") < F.col("_share")) & (F.col("_b") <= F.col("_most")))
    rows = chosen.groupBy("_h").agg(F.min(F.struct("lang", "text")).alias("r")).select("_h", "r.*").collect()  # about sample rows of each language, sample_bytes in all
    model = fit([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["_h"], r["text"]))])
    del rows
    tidy(0)  # the driver lives on, and has the sample no more
    return model


def _predict(model, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        for batch in slices(batches):
            lang, score, accepted = [], [], []
            for text in batch.column("text").to_pylist():
                if not text or not any(map(str.isalpha, text)) or not m.languages:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    accepted.append(False)
                    continue
                p = m.probabilities(text)
                lang.append(m.languages[int(p.argmax())])
                score.append(float(p.max()))
                accepted.append(score[-1] >= m.accept)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=[*keep, "lang_pred", "score", "accepted"])

    return run


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with lang_pred, score (0 to 1) and accepted, for docs (text, ...).

    lang_pred is ``und`` with score 0, and rejected, where a text is null, empty or without letters; whole texts of any
    length are read; of languages with equal scores the first by name wins.  Only the text is read.  One narrow pass;
    repeated rows are kept; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    used = docs.select(*keep, *(["text"] if "text" not in keep else []))
    schema = ", ".join(f"`{c}` {t}" for c, t in used.select(*keep).dtypes) + ", lang_pred string, score double, accepted boolean"
    return used.mapInArrow(_predict(spark.sparkContext.broadcast(model), keep), schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every row of docs (doc_id, text, lang, ...), with a model trained there.

    held_out is false for a null doc_id.  Null lang: not learned from.  Null and empty texts and texts without letters are
    `und`, score 0; whole texts of any length are read.  Repeated rows come back as often; ties go to the first language by
    name; other columns are left alone; an empty table gives an empty result, and so do all texts `und` where nothing is labelled.
    """
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
