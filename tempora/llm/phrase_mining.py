"""Phrase collocation mining: merged count-min sketches choose which n-grams are counted, an exact pass counts those.

A sketch never counts too low, so no frequent phrase is lost; what it lets through in error falls to the exact counts.
Phrases are then scored at their weakest cut, and those that live inside longer ones go.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import cut, mix64, numbered_words, parallelism, prepare, reads, slices

BREAKS = r"[.,;:!?\x0A-\x0D]+"
#: Counters of one of a sketch's two rows: one for BYTES_EACH bytes of text, but from 2^LEAST_BITS to 2^MOST_BITS.
BYTES_EACH, LEAST_BITS, MOST_BITS = 64, 18, 26
#: Counters that travel together, and adds between looks for counters that are full.
TILE, ADDS = 1 << 16, 60_000
#: Bytes of text that a task looks at together, and phrases that it counts before it hands them on.
TOGETHER, HELD = 4 << 20, 2_000_000
#: A word is a number of so many bits inside a task, so three words are one number of 63 bits.
WORD_BITS = 21
#: Groups that the candidates of a language are dealt to before the best of all are chosen, and most groups that counts are dealt to.
LANES, GROUPS = 32, 1024


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, list[str], np.ndarray]:
    """(words as numbers, which are words, words, language of each as a number, languages, hashes of the words): texts one after another.

    A break between pieces, and the end of a text, is a number of its own that is no word.
    """
    text = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), BREAKS, " . ")
    numbers, bounds, words = numbered_words(pc.binary_join_element_wise(text, pa.scalar(" ."), ""), ascii_only=True)
    langs = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
    lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(bounds))
    is_word = numbers != (words.index(b".") if b"." in words else -1)
    return numbers, is_word, words, lang, langs.dictionary.to_pylist(), np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def _first_keys(numbers: np.ndarray, lang: np.ndarray, langs: list[str], hashes: np.ndarray) -> np.ndarray:
    return mix64(hashes[numbers] + np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in langs], np.uint64)[lang])


def _longer_keys(keys: np.ndarray, following: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(keys * np.uint64(0x9E3779B97F4A7C15) + following)


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return (keys & low).astype(np.int64), ((keys >> np.uint64(32)) & low).astype(np.int64) + (1 << bits)


class _Text:
    """The n-grams of a batch, length by length: where one begins and its key; only those whose parts passed are gone on with."""

    def __init__(self, batch: pa.RecordBatch):
        self.numbers, is_word, self.words, self.lang, self.langs, self.hashes = _read(batch)
        self.is_word, self.n = is_word, 1
        self.at = np.flatnonzero(is_word)
        self.keys = _first_keys(self.numbers, self.lang, self.langs, self.hashes)[self.at]

    def keep(self, passed: np.ndarray) -> None:
        self.at, self.keys = self.at[passed], self.keys[passed]

    def lengthen(self) -> None:
        """To the n-grams of one word more whose first n words and last n words are both among those kept."""
        both = np.zeros(len(self.numbers) + 1, bool)
        both[self.at] = True
        going = both[self.at + 1]
        self.at = self.at[going]
        self.keys = _longer_keys(self.keys[going], self.hashes[self.numbers[self.at + self.n]])
        self.n += 1


class Sketch:
    """Two rows of 2^bits counters over keys, one after the other; counters stop at ``least``."""

    def __init__(self, table: np.ndarray, bits: int, least: int):
        self.table, self.bits, self.least = table, bits, least

    def passes(self, keys: np.ndarray) -> np.ndarray:
        low, high = _places(keys, self.bits)
        return (self.table[low] >= self.least) & (self.table[high] >= self.least)


def _sketch(bits: int, least: int, longest: int, lanes: int, short: object) -> Callable:
    """Count words and pairs; with ``short``, their sketch, count longer n-grams all of whose pairs it lets through."""
    kept, wide, adds = (np.uint8, np.uint16, ADDS) if least <= 255 else (np.uint32, np.uint64, 1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 << bits, wide)
        one = wide(1)
        for batch in slices(batches, most=TOGETHER):
            text = _Text(batch)
            for n in range(1, (longest if short is not None else min(longest, 2)) + 1):
                if n > 1:
                    text.lengthen()
                if short is not None and n <= 2:
                    text.keep(short.value.passes(text.keys))
                    continue
                for at in _places(text.keys, bits):
                    for i in range(0, len(at), adds):  # counters stop at ``least``, so none overflows in between
                        some = at[i : i + adds]
                        np.add.at(table, some, one)
                        table[some[table[some] > least]] = least
        lane = TaskContext.get().partitionId() % lanes
        for tile in range(0, len(table), TILE):
            part = table[tile : tile + TILE]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"tile": tile // TILE, "lane": lane, "counts": zstandard.compress(part.astype(kept).tobytes(), 1)}], SKETCH)

    return run


SKETCH = pa.schema([("tile", pa.int32()), ("lane", pa.int32()), ("counts", pa.binary())])


def _merge(least: int) -> Callable:
    """Add up the parts of each tile, which come one after another; one tile is held at a time."""
    kept, wide = (np.uint8, np.uint16) if least <= 255 else (np.uint32, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(TILE, wide)
        out = lambda: pa.RecordBatch.from_pylist([{"tile": now[0], "lane": now[1], "counts": zstandard.compress(total.astype(kept).tobytes(), 1)}], SKETCH)
        for batch in batches:
            for tile, lane, counts in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (tile, lane) != now:
                    if now is not None:
                        yield out()
                    now, total = (tile, lane), np.zeros(TILE, wide)
                total = np.minimum(total + np.frombuffer(zstandard.decompress(counts), kept), wide(least))
        if now is not None:
            yield out()

    return run


def sketch_bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (size // BYTES_EACH).bit_length()))


def count_min(docs: DataFrame, least: int, longest: int, bits: int, short: object = None) -> Sketch:
    """A sketch of the words and pairs of every text, or given the broadcast of that one, of its longer n-grams.

    Each task counts its own texts; the parts are added up tile by tile, by lanes first where many tasks wrote some.
    """
    n = parallelism(docs.sparkSession)
    lanes = 1 if n < 256 else isqrt(n)
    parts = docs.select("text", "lang").mapInArrow(_sketch(bits, least, longest, lanes, short), "tile int, lane int, counts binary")
    merged = parts.repartition(n, "tile", "lane").sortWithinPartitions("tile", "lane").mapInArrow(_merge(least), parts.schema)
    if lanes > 1:
        merged = merged.withColumn("lane", F.lit(0)).repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(_merge(least), parts.schema)
    table = np.zeros(2 << bits, np.uint8 if least <= 255 else np.uint32)
    for r in merged.select("tile", "counts").collect():  # 2^(bits + 1) counters
        table[r.tile * TILE : (r.tile + 1) * TILE] = np.frombuffer(zstandard.decompress(bytes(r.counts)), table.dtype)
    return Sketch(table, bits, least)


COUNTS = "lang string, bucket int, phrases binary, counts binary"


class _Counts:
    """Exact counts of phrases as numbers of their words: one number for the first three, one for those after."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, bytes], int] = {}
        self.names: list[tuple[str, bytes]] = []
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def number(self, lang: str, word: bytes) -> int:
        found = self.numbers.setdefault((lang, word), len(self.names))
        if found == len(self.names):
            self.names.append((lang, word))
        return found

    def add(self, n: int, head: np.ndarray, tail: np.ndarray, times: np.ndarray) -> None:
        self.parts.setdefault(n, []).append((head, tail, times))
        self.held += len(head)

    def compact(self) -> None:
        self.held = 0
        for n, parts in self.parts.items():
            head, tail, times = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((tail, head))
            head, tail, times = head[order], tail[order], times[order]
            begins = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])) if len(head) else np.zeros(0, np.int64)
            self.parts[n] = [(head[begins], tail[begins], np.add.reduceat(times, begins) if len(begins) else times)]
            self.held += len(begins)

    def packed(self, groups: int) -> Iterator[pa.RecordBatch]:
        """Rows of COUNTS: the phrases of one language and group in order, and how often each occurs."""
        self.compact()
        found: dict[tuple[str, int], list[tuple[bytes, int]]] = {}
        low = (1 << WORD_BITS) - 1
        for n, [(head, tail, times)] in self.parts.items():
            columns = [head >> (WORD_BITS * (min(n, 3) - 1 - i)) & low for i in range(min(n, 3))] + [tail >> (WORD_BITS * (n - 4 - i)) & low for i in range(n - 3)]
            for *ids, c in zip(*[x.tolist() for x in columns], times.tolist(), strict=True):
                phrase = b" ".join([self.names[i][1] for i in ids])
                found.setdefault((self.names[ids[0]][0], zlib.crc32(phrase) % groups), []).append((phrase, c))
        for (lang, bucket), rows in found.items():
            rows.sort()
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([bucket], pa.int32()), pa.array([zstandard.compress(b"\n".join([r[0] for r in rows]), 3)], pa.binary()), pa.array([zstandard.compress(np.array([r[1] for r in rows], np.int64).tobytes(), 3)], pa.binary())], names=["lang", "bucket", "phrases", "counts"])


def _count(short: object, long: object, longest: int, groups: int) -> Callable:
    """Exact counts of the n-grams that the sketches let through; a phrase holds no line break, so one parts them.

    The number of all words of a language goes with the empty phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = _Counts(), Counter()
        for batch in slices(batches, most=TOGETHER):
            text = _Text(batch)
            for i, c in enumerate(np.bincount(text.lang[text.is_word], minlength=len(text.langs))):
                words[text.langs[i]] += int(c)
            if len(counts.names) + len(text.words) * len(text.langs) >= 1 << WORD_BITS or counts.held >= HELD:
                counts.compact()
                if len(counts.names) + len(text.words) * len(text.langs) >= 1 << WORD_BITS or counts.held >= HELD // 2:
                    yield from counts.packed(groups)
                    counts = _Counts()
            size = len(text.words)
            text.keep(short.value.passes(text.keys))
            found, back, times = np.unique(text.lang[text.at] * size + text.numbers[text.at], return_inverse=True, return_counts=True)
            own = np.array([counts.number(text.langs[x // size], text.words[x % size]) for x in found.tolist()], np.int64)
            if len(own) and own.max() >= 1 << WORD_BITS:
                raise ValueError("more than two million frequent words in one text")
            counts.add(1, own, np.zeros(len(own), np.int64), times)
            named = np.zeros(len(text.numbers), np.int64)
            named[text.at] = own[back]
            for n in range(2, longest + 1):
                text.lengthen()
                text.keep((short if n == 2 else long).value.passes(text.keys))
                head, tail = named[text.at], np.zeros(len(text.at), np.int64)
                for i in range(1, n):
                    if i < 3:
                        head = head << WORD_BITS | named[text.at + i]
                    else:
                        tail = tail << WORD_BITS | named[text.at + i]
                firsts, rank = np.unique(head, return_inverse=True)
                if n <= 3:
                    counts.add(n, firsts, np.zeros(len(firsts), np.int64), np.bincount(rank, minlength=len(firsts)))
                else:
                    order = np.lexsort((tail, rank))
                    rank, tail = rank[order], tail[order]
                    begins = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (tail[1:] != tail[:-1])])) if len(rank) else np.zeros(0, np.int64)
                    counts.add(n, firsts[rank[begins]], tail[begins], np.diff(np.append(begins, len(rank))))
        yield from counts.packed(groups)
        for lang, c in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([0], pa.int32()), pa.array([zstandard.compress(b"")], pa.binary()), pa.array([zstandard.compress(np.array([c], np.int64).tobytes())], pa.binary())], names=["lang", "bucket", "phrases", "counts"])

    return run


def _total(least: int) -> Callable:
    """Add up the counts of each language and group, whose rows come one after another; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[str, int] | None = None
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            kept = [(p.decode(), c) for p, c in held.items() if c >= least or not p]
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(kept), pa.string()), pa.array([p.count(" ") + 1 if p else 0 for p, _ in kept], pa.int32()), pa.array([p for p, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.int64())], names=["lang", "words", "phrase", "f"])

        for batch in batches:
            for lang, bucket, phrases, counts in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if (lang, bucket) != now:
                    if now is not None:
                        yield out()
                    now, held = (lang, bucket), {}
                for p, c in zip(zstandard.decompress(phrases).split(b"\n"), np.frombuffer(zstandard.decompress(counts), np.int64).tolist(), strict=True):
                    held[p] = held.get(p, 0) + c
        if now is not None:
            yield out()

    return run


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4) -> DataFrame:
    """(lang, words, phrase, f): exact counts of all phrases of up to ``longest`` words (2 to 6) that occur ``least`` times or more in a language.

    A row of 0 words and the empty phrase holds the number of all word occurrences of the language.  Words and pairs are
    sketched first, then the longer n-grams whose pairs are all let through, which are few; tasks count what both let through
    and hand on packed groups of phrases, so that what is shuffled is one row for each task, language and group.
    """
    if not 2 <= longest <= 6:
        raise ValueError("phrases have 2 to 6 words")
    spark = prepare(docs.sparkSession)
    bits, n = sketch_bits(docs), parallelism(spark)
    short = spark.sparkContext.broadcast(count_min(docs, least, longest, bits))
    long = spark.sparkContext.broadcast(count_min(docs, least, longest, max(bits - 1, min(bits, LEAST_BITS)), short)) if longest > 2 else None
    found = docs.select("text", "lang").mapInArrow(_count(short, long, longest, min(GROUPS, n)), COUNTS)
    added = found.repartition(n, "lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(_total(least), "lang string, words int, phrase string, f long")
    out = cut(added, "phrases")
    for b in (short, long):
        if b is not None:
            b.destroy()
    return out


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, inside: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language of docs (text, lang).

    A phrase of two words or more is cut where floor(2000000 a / (l + r)) is lowest, at the first such place; it goes if a longer
    phrase that holds its words in a row occurs at least ``inside`` hundredths as often.  Ranks go by score and a, falling, then
    by the phrase's bytes.  Counts are exact; products are decimals of 38 digits.

    Null text: no words.  Null lang: `und`, with texts that say so.  Texts of any length count whole; a text's last words and the
    next one's first are never one phrase.  Repeated rows count each time.  Tables without a frequent phrase, or without rows, give
    no rows.  Other columns are left alone.  A sketch is at most 2^(MOST_BITS + 1) counters: beyond some 4 GB of text it lets
    more through for the exact pass, which then counts and shuffles more, but the result is the same.
    """
    counted = phrase_counts(docs, least, longest)
    phrases = counted.where("words > 0").select("lang", "words", "phrase", F.col("f").alias("a"))
    long_ones = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))
    # one question for each side of each cut, all answered by one join
    span = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    asked = long_ones.select("lang", "words", F.col("phrase").alias("whole"), "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("is_left"), span(F.lit(1), k).alias("phrase")),
        F.struct(k.alias("k"), F.lit(False).alias("is_left"), span(k + 1, F.col("words") - k).alias("phrase")),
    )))).alias("q")).select("lang", "words", "whole", "a", "q.*")
    told = asked.join(phrases.select("lang", "phrase", F.col("a").alias("f")), ["lang", "phrase"])
    side = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("is_left") == left), F.col("f")))
    sides = told.groupBy("lang", "whole", "words", "a").agg(*[side(k, left).alias(f"{'l' if left else 'r'}{k}") for k in range(1, longest) for left in (True, False)])
    scored = [F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"(CAST(a AS DECIMAL(20,0)) * 2000000) div (CAST(l{k} AS DECIMAL(20,0)) + CAST(r{k} AS DECIMAL(20,0)))").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    best = sides.select("lang", F.col("whole").alias("phrase"), "a", F.least(*scored).alias("c") if len(scored) > 1 else scored[0].alias("c"))
    parts = long_ones.where("words > 2").select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: span(i, n))))).alias("phrase"))
    around = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(around, ["lang", "phrase"], "left").where(f"longer is null or CAST(longer AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {int(inside)}")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(LANES))
    flat = left.select("lang", "phrase", "a", "c.score", "c.l", "c.r").withColumn("lane", lane)
    few = flat.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order))).where(f"rank <= {int(top)}").drop("rank", "lane")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {int(top)}")
    out = ranked.join(counted.where("words = 0").select("lang", F.col("f").alias("n")), "lang")
    return reads(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), counted)
