"""Operator 10: quality classifier from weak labels.

1.  Ten heuristic labellers look at every document and vote good (1), bad (-1) or abstain (0).
2.  The votes of all documents are counted by pattern (at most 3**10 of them), and expectation-maximisation over the
    patterns estimates how each labeller votes on good documents and on each kind of bad ones, and how many there are of
    each.  A document is good or bad in one of a few ways: labellers of one flaw overlap, and say nothing of another.
3.  The posterior of a document's pattern labels it.  A linear scorer over hashed word shapes, their pairs and
    statistics of the text is trained on the posteriors of a bounded sample by stochastic gradient descent, and scores
    all documents; so it also decides where labellers abstain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import code_points, every_character, mix64, numbered_words, prepare, slices, tidy

LABELLERS = ("symbols", "shouting", "separators", "repeated_words", "sentences", "repeated_lines", "letters", "top_word", "repeated_pairs", "runs")
#: Labellers, by number, that look for one kind of flaw.
KINDS = ((0, 6), (1,), (2, 7), (3, 5, 8, 9), (4,))
FEATURES = 1 << 14
#: Documents to train on for each class, bytes of all of them together, and bytes of one: longer texts are not among them.
SAMPLE, SAMPLE_BYTES, ROW_BYTES = 2500, 64 << 20, 200_000
#: Documents that score below are rejected.
KEEP = 0.5
SYMBOLS = "#$%&*@^~<>{}=\\|+_"
ENDS = ".!?…。"
#: Flags of a character and of a word.
LETTER, UPPER, LOWER, DIGIT, SYMBOL, END = 1, 2, 4, 8, 16, 32
NOISY, CAPITAL, BARE, ENDING, LONG = range(5)


@cache
def characters() -> np.ndarray:
    """Flags of every code point."""
    table = np.zeros(0x110000, np.uint8)
    every = every_character()
    for flag, pattern in ((LETTER, r"\p{L}+"), (UPPER, r"\p{Lu}+"), (LOWER, r"\p{Ll}+"), (DIGIT, r"\p{Nd}+")):
        for m in regex.finditer(pattern, every):
            table[code_points(m[0])] |= flag
    for flag, some in ((SYMBOL, SYMBOLS), (END, ENDS)):
        table[[ord(c) for c in some]] |= flag
    return table


def shapes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed shape, flags[5], letters, length) of each word, all words at once.

    A shape is the word's first 64 characters as upper, lower, digit or themselves, runs cut to two.
    """
    points = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10)
    start = np.concatenate([[0], ends[:-1] + 1])
    length = ends - start
    flag = characters()[points]
    kind = np.where(flag & UPPER, 1, np.where(flag & LETTER, 2, np.where(flag & DIGIT, 3, points + 16))).astype(np.uint64)
    place = np.arange(len(points)) - np.repeat(start, length + 1)
    keep = (place < 64) & (points != 10)
    keep[2:] &= ~((kind[2:] == kind[1:-1]) & (kind[2:] == kind[:-2]) & (place[2:] >= 2))
    upto = np.cumsum(keep)
    rank = (upto - np.repeat(upto[start] - keep[start], length + 1)).astype(np.uint64)
    with np.errstate(over="ignore"):
        each = mix64(kind + (rank << np.uint64(32))) * keep
        shape = mix64(np.add.reduceat(each, start))

    def count(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.int64), start)

    letters, upper = count(flag & LETTER > 0), count(flag & UPPER > 0)
    twice = np.zeros(len(points), bool)
    twice[:-1] = (flag[:-1] & flag[1:] & SYMBOL) > 0
    flags = np.stack([count(twice) > 0, (letters > 1) & (upper > 0) & (count(flag & LOWER > 0) == 0), (letters == 0) & (flag[start] & DIGIT == 0), flag[np.maximum(ends - 1, start)] & END > 0, length > 40], 1)
    return shape, flags, letters, length


class Looks:
    """What the labellers and the scorer see of the texts of one column."""

    def __init__(self, column: pa.Array):
        numbers, self.bounds, words = numbered_words(column)
        n = self.n = np.diff(self.bounds)
        shape, flags, letters, length = shapes(words) if words else (np.empty(0, np.uint64), np.zeros((0, 5), bool), np.empty(0, np.int64), np.empty(0, np.int64))
        self.shape = shape[numbers]

        def total(x: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(x)])[self.bounds])

        per = np.maximum(n, 1)
        self.share = np.stack([total(flags[numbers, f]) / per for f in range(5)], 1)
        again = np.zeros(len(numbers))
        again[:-1] = numbers[1:] == numbers[:-1]
        inner = self.bounds[1:-1]
        again[inner[inner > 0] - 1] = 0
        self.again = total(again) / per
        self.letters = total(letters[numbers]) / np.maximum(total(length[numbers]), 1)
        m = len(n)
        self.top, self.distinct, self.lines, self.lines_again = np.zeros(m), np.zeros(m), np.zeros(m, np.int64), np.zeros(m)
        self.pairs, self.longest = np.ones(m), np.zeros(m, np.int64)
        ends = np.flatnonzero(again == 0)  # a run of one word ends where the next differs
        run = np.diff(ends, prepend=-1)
        two = numbers[:-1] * len(words) + numbers[1:] if len(numbers) else numbers
        for i, text in enumerate(column.to_pylist()):
            if n[i]:
                a, b = self.bounds[i], self.bounds[i + 1]
                counts = np.unique(numbers[a:b], return_counts=True)[1]
                self.top[i], self.distinct[i] = counts.max() / n[i], len(counts) / n[i]
                self.longest[i] = run[np.searchsorted(ends, a) : np.searchsorted(ends, b)].max()
                if n[i] > 1:
                    self.pairs[i] = len(np.unique(two[a : b - 1])) / (n[i] - 1)
                lines = [x for x in map(str.strip, text.split("\n")) if x]
                self.lines[i], self.lines_again[i] = len(lines), 1 - len(set(lines)) / len(lines) if lines else 0.0

    def patterns(self) -> np.ndarray:
        """The votes of all labellers on each text as one number."""
        s, n = self.share, self.n
        votes = [
            (s[:, NOISY] > 0.15, s[:, NOISY] < 0.02),
            ((s[:, CAPITAL] > 0.4) & (n >= 5), s[:, CAPITAL] < 0.1),
            ((s[:, BARE] > 0.2) & (n >= 5), s[:, BARE] < 0.05),
            ((self.again > 0.2) | ((n >= 100) & (self.distinct < 0.08)), self.again < 0.03),
            ((s[:, ENDING] < 1 / 80) & (n >= 80), s[:, ENDING] > 1 / 40),
            ((self.lines >= 5) & (self.lines_again > 0.4), (self.lines >= 2) & (self.lines_again < 0.1)),
            (self.letters < 0.7, self.letters > 0.88),
            ((self.top > 0.3) & (n >= 15), (self.top < 0.15) & (n >= 15)),
            ((self.pairs < 0.6) & (n >= 12), self.pairs > 0.9),
            (self.longest >= 5, self.longest < 4),
        ]
        found = sum(np.where(bad | (n == 0), 0, np.where(good, 2, 1)) * 3**i for i, (bad, good) in enumerate(votes))
        return np.asarray(found, np.int64)

    def features(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, weights) of text i: shares of hashed shapes and pairs of shapes, then binned statistics."""
        shape = self.shape[self.bounds[i] : self.bounds[i + 1]]
        with np.errstate(over="ignore"):
            pairs = shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:]
        counts = np.bincount((mix64(np.concatenate([shape, pairs])) & np.uint64(FEATURES - 1)).astype(np.int64), minlength=FEATURES)
        ids = np.flatnonzero(counts)
        s = self.share[i]
        binned = [s[NOISY], s[CAPITAL], s[BARE], s[ENDING], self.again[i], self.lines_again[i], 1 - self.letters[i], self.top[i], 1 - self.distinct[i], s[LONG], 1 - self.pairs[i], self.longest[i] / 20]
        more = [FEATURES + 1 + 12 * j + min(11, int(12 * min(1.0, x * 2))) for j, x in enumerate(binned)]
        return np.append(ids, [FEATURES, *more]), np.append(counts[ids] / max(self.n[i], 1), np.full(1 + len(more), 0.5))


WIDTH = FEATURES + 1 + 12 * 12


def votes_of(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 - 1 for i in range(len(LABELLERS))]


def estimate(counts: dict[int, int], rounds: int = 300) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """(shares of the classes, table[labeller, class, vote + 1], posterior of good by pattern) by expectation-maximisation.

    Class 0 is good, the others are the kinds of bad documents.  It starts from labellers that rarely find fault with a
    good document and mostly do with the flaw they look for; that belief keeps a third of the weight in each class.
    """
    patterns, classes, every = sorted(counts), 1 + len(KINDS), np.arange(len(LABELLERS))
    belief = np.empty((len(LABELLERS), classes, 3))
    belief[:, 0], belief[:, 1:] = [0.02, 0.13, 0.85], [0.1, 0.13, 0.77]
    for kind, own in enumerate(KINDS, 1):
        belief[list(own), kind] = [0.8, 0.13, 0.07]
    share = np.array([0.8, *[0.2 / len(KINDS)] * len(KINDS)])
    if not patterns:
        return share, belief, {}
    v = np.array([votes_of(p) for p in patterns]) + 1
    n = np.array([counts[p] for p in patterns], float)
    table, before = belief.copy(), None
    for _ in range(rounds):
        logs = np.log(table[every[None, :, None], np.arange(classes)[None, None, :], v[:, :, None]]).sum(1) + np.log(share)
        q = np.exp(logs - logs.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        weight = n[:, None] * q
        for i in every:
            seen = np.stack([weight[v[:, i] == vote].sum(0) for vote in range(3)], 1)
            seen += belief[i] * (1 + 0.5 * weight.sum(0) + 0.002 * n.sum())[:, None]
            table[i] = seen / seen.sum(1, keepdims=True)
        share = (weight.sum(0) + 1) / (n.sum() + classes)
        if before is not None and np.abs(q - before).max() < 1e-7:
            break
        before = q
    return share, table, dict(zip(patterns, q[:, 0].tolist(), strict=True))


def fit(rows: list[tuple[str, float]], epochs: int = 6, rate: float = 1.0, seed: int = 3) -> np.ndarray:
    """Weights of the scorer from (text, posterior) rows; both classes weigh the same."""
    rng, data = np.random.default_rng(seed), []
    for at in range(0, len(rows), 500):
        looks = Looks(pa.array([t for t, _ in rows[at : at + 500]], pa.string()))
        data += [(*looks.features(i), y) for i, (_, y) in enumerate(rows[at : at + 500])]
    w = np.zeros(WIDTH)
    total = sum(y for *_, y in data)
    balance = {1: len(data) / (2 * max(total, 1)), 0: len(data) / (2 * max(len(data) - total, 1))} if data else {}
    step, done = epochs * len(data), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            ids, x, y = data[i]
            p = 1 / (1 + np.exp(-np.clip(w[ids] @ x, -30, 30)))
            w[ids] -= rate * (1 - done / step) * min(5.0, balance[int(y >= 0.5)]) * (p - y) * x
            done += 1
    return w


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(Looks(batch.column("text")).patterns(), pa.int32())], names=["pattern"])


def _score(model, keep: float, columns: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = model.value
        for batch in slices(batches):
            looks = Looks(batch.column("text"))
            s = np.zeros(batch.num_rows)
            for i in np.flatnonzero(looks.n):
                ids, x = looks.features(i)
                s[i] = 1 / (1 + np.exp(-np.clip(weights[ids] @ x, -30, 30)))
            post = [posterior.get(p, 0.5) for p in looks.patterns().tolist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(post, pa.float64()), pa.array(s), pa.array(s >= keep)], names=[*columns, "posterior", "quality_score", "kept"])

    return run


def classify_quality(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE, keep: float = KEEP, sample_bytes: int = SAMPLE_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``columns`` with posterior, quality_score (0 to 1) and kept, of every row of docs (doc_id, text, ...).

    Null, empty and white texts score 0 and are rejected; whole texts of any length are looked at.  Votes of all documents
    are counted.  The scorer learns from about ``sample`` documents of each class and about ``sample_bytes`` of text, chosen by a hash of doc_id
    and text (so copies under one id, and null ids, count once for each text), whole and in the order of that hash: how files
    and partitions lie changes nothing.  Texts of more than ``row_bytes`` are not chosen, unless there are no others.  A posterior of 0.5 counts as good, a score of ``keep`` is kept.  Repeated rows are
    kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    voted = docs.select("text").mapInArrow(_vote, "pattern int")
    counts = {r.pattern: r.n for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # at most 3**10 rows
    _, _, posterior = estimate(counts)
    size = {c: sum(n for p, n in counts.items() if (posterior[p] >= 0.5) == bool(c)) for c in (0, 1)}
    known = spark.sparkContext.broadcast(posterior)
    sized = docs.where("text <> ''").select("text", F.octet_length("text").alias("b"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("h"))
    short = F.col("b") <= row_bytes
    found = sized.agg(F.count("*").alias("n"), F.sum("b").alias("bytes"), F.sum(F.when(short, 1)).alias("n_short"), F.sum(F.when(short, F.col("b"))).alias("bytes_short")).first()
    mean = (found.bytes_short or found.bytes or 0) / max(found.n_short or found.n, 1)  # bytes of a document that may be chosen
    share = [min(1.0, min(sample, sample_bytes / 2 / max(mean, 1)) / max(size[c], 1)) for c in (0, 1)]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h = batch.column("h").to_numpy()
            post = np.array([known.value.get(p, 0.5) for p in Looks(batch.column("text")).patterns().tolist()])
            take = pa.array(np.flatnonzero(h < np.where(post >= 0.5, share[1], share[0]) * (1 << 40)))
            if len(take):
                yield pa.RecordBatch.from_arrays([batch.column("h").take(take), batch.column("text").take(take), pa.array(post).take(take)], names=["h", "text", "y"])

    hashed = (sized.where(short) if found.n_short else sized).where(F.col("h") < int(max(share) * (1 << 40))).select("text", "h")
    rows = hashed.mapInArrow(choose, "h long, text string, y double").dropDuplicates(["h"]).collect()  # about 2 * sample rows, sample_bytes in all
    weights = fit([(r.text, r.y) for r in sorted(rows, key=lambda r: (r.h, r.text))])
    del rows
    tidy(0)  # the driver lives on, and has the sample no more
    used = docs.select(*columns, *(["text"] if "text" not in columns else []))
    schema = ", ".join(f"`{c}` {t}" for c, t in used.select(*columns).dtypes) + ", posterior double, quality_score double, kept boolean"
    return used.mapInArrow(_score(spark.sparkContext.broadcast((weights, posterior)), keep, columns), schema)
