"""Operator 8: best-fit packing of token sequences by a grouping genetic algorithm.

1.  One scan tokenises whole texts and cuts those longer than a sequence.  Pieces that fill a sequence
    are done; the others are dealt by hash into blocks of bounded size.
2.  Each block is packed by best fit.  Blocks whose bins are as few as a lower bound says are done; the others are
    packed by islands.  A crossover injects whole well-filled bins of one solution into
    another, removes the duplicates together with the bins that held them, and best-fits the displaced
    pieces; a mutation dissolves the least filled bins.  Between epochs the best solution of each island
    migrates to the next island of its block.
3.  Bins filled to 99.8 per cent stay.  The pieces of the others, of all blocks, are dealt again and packed
    together, level by level, until one block is left or dealing again saves less than a thousandth of the bins.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import cut, numbered_words, prepare, reads, release, slices, tidied

CAPACITY, BLOCK, FULL = 4096, 6000, 0.998
#: The pattern of word_bpe_49k.json, for chunks in which all letters are Latin.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks and words that a worker remembers (some 200 bytes each); once full, they only serve.
REMEMBER = (700_000, 500_000)


class ChunkIds:
    """Little-endian 32-bit ids of texts, as the tokenizer gives them.

    The tokenizer's patterns never match across white space, so the ids of a text are those of its chunks (texts with
    U+001C to U+001F, which only the splitter takes for white space, are encoded whole); those of a plain
    chunk are those of its words, each of which ends in a token that ends words.  Words not yet known are encoded together.
    """

    def __init__(self, path: str, remember: tuple[int, int] = REMEMBER):
        self.most_chunks, self.most_words = remember
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
        if len(ends) != len(words) or (len(ids) and ends[-1] != 4 * len(ids)):
            return {w: self.alone(w) for w in words}
        raw, starts = ids.tobytes(), [0, *ends[:-1].tolist()]
        return {w: raw[i:j] for w, i, j in zip(words, starts, ends.tolist(), strict=True)}

    def _resolve(self, missing: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        split: dict[str, list[str]] = {}
        for c in missing:
            if "<|" in c or not c.isascii() and max(c) > "\u024f":
                out[c] = self.alone(c)
            else:
                plain = c.lower() if c.isascii() else self.tokenizer.normalizer.normalize_str(c)
                split[c] = WORDS.findall(plain)
        unknown = list({w for ws in split.values() for w in ws if w not in self.words})
        fresh: dict[str, bytes] = {}
        for i in range(0, len(unknown), 5000):
            fresh |= self._learn(unknown[i : i + 5000])
        known = self.words
        for c, ws in split.items():
            out[c] = b"".join([known[w] if w in known else fresh[w] for w in ws])
        if len(known) < self.most_words:
            known |= fresh
        return out

    def encode_all(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column; each distinct chunk is looked up once, and new ones are settled together."""
        numbers, bounds, chunks = numbered_words(column)
        found = list(map(self.chunks.get, chunks))
        missing = [c for c, x in zip(chunks, found, strict=True) if x is None and c]
        fresh = self._resolve(missing)
        raw = [fresh.get(c, b"") if x is None else x for c, x in zip(chunks, found, strict=True)]
        if len(self.chunks) < self.most_chunks:
            self.chunks |= fresh
        ids = np.frombuffer(b"".join(raw), "<u4")
        size = np.array([len(x) // 4 for x in raw], np.int64)
        start = np.cumsum(size) - size
        n = size[numbers]
        upto = np.concatenate([[0], np.cumsum(n)])
        every = ids[np.repeat(start[numbers] - upto[:-1], n) + np.arange(upto[-1])]
        out = np.split(every, upto[bounds[1:-1]])
        odd = np.flatnonzero(np.asarray(pc.match_substring_regex(pc.fill_null(column, ""), "[\\x1c-\\x1f]")))
        for i in odd.tolist():
            out[i] = np.frombuffer(self.alone(column[i].as_py()), "<u4")
        return out


_CODERS: dict[tuple, ChunkIds] = {}


def coder(path: str, remember: tuple[int, int]) -> ChunkIds:
    """One for each worker process, kept between tasks."""
    if (path, remember) not in _CODERS:
        _CODERS[path, remember] = ChunkIds(path, remember)
    return _CODERS[path, remember]


def _pieces(path: str, end: int, capacity: int, with_ids: bool, remember: tuple[int, int]):
    tail = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, remember)
        for batch in slices(batches, most=4 << 20):
            cols: list[list] = [[] for _ in names]
            for doc, found in zip(batch.column("doc_id").to_pylist(), c.encode_all(batch.column("text")), strict=True):
                ids = found.tobytes() + tail
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for col, x in zip(cols, (doc, p, at // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                        col.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=False)], names=names)

    return run


class Bins:
    """A solution: the items of each bin and its fill; best fit by a sorted list of (room, bin)."""

    def __init__(self, length: list[int], capacity: int):
        self.length, self.capacity = length, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    @classmethod
    def of(cls, length: list[int], capacity: int, groups: list[list[int]]) -> Bins:
        b = cls(length, capacity)
        b.items = [g for g in groups if g]
        b.fill = [sum(map(length.__getitem__, g)) for g in b.items]
        return b

    def best_fit(self, loose: list[int]) -> None:
        """Put loose items, the longest first, where they leave the least room."""
        room = sorted((self.capacity - f, i) for i, f in enumerate(self.fill) if f < self.capacity)
        for x in sorted(loose, key=lambda x: (-self.length[x], x)):
            n = self.length[x]
            at = bisect.bisect_left(room, (n, -1))
            if at < len(room):
                left, i = room.pop(at)
                self.items[i].append(x)
                self.fill[i] += n
            else:
                left, i = self.capacity, len(self.items)
                self.items.append([x])
                self.fill.append(n)
            if left > n:
                bisect.insort(room, (left - n, i))

    def swap_in(self, loose: list[int]) -> list[int]:
        """Put longer loose items in the place of shorter ones where a bin has the room, the best fit first; what is loose then."""
        free = sorted((self.length[x], x) for x in loose)
        for i, g in enumerate(self.items):
            room = self.capacity - self.fill[i]
            for k in range(len(g)):
                if not room or not free:
                    break
                n = self.length[g[k]]
                at = bisect.bisect_right(free, (n + room, len(self.length))) - 1
                if at >= 0 and free[at][0] > n:
                    longer, y = free.pop(at)
                    bisect.insort(free, (n, g[k]))
                    g[k] = y
                    self.fill[i] += longer - n
                    room -= longer - n
        return [x for _, x in free]

    def fitness(self) -> float:
        """Falkenauer's: the mean of squared fill, larger for fuller bins."""
        f = np.array(self.fill, float) / self.capacity
        return float((f * f).mean()) if len(f) else 1.0

    def rank(self) -> tuple[int, float]:
        return len(self.items), -self.fitness()

    def labels(self) -> list[int]:
        out = [0] * len(self.length)
        for i, g in enumerate(self.items):
            for x in g:
                out[x] = i
        return out


def groups_of(labels) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(labels, default=-1) + 1)]
    for x, i in enumerate(labels):
        out[i].append(x)
    return out


def crossover(donor: Bins, receiver: Bins, rng: np.random.Generator) -> Bins:
    """Inject a third of the donor's well-filled bins into the receiver, drop what they touch there, best-fit what that displaces."""
    filled = np.array(donor.fill) >= np.quantile(donor.fill, 0.3)
    chosen = np.flatnonzero(filled & (rng.random(len(filled)) < 0.3))
    injected = [donor.items[i] for i in chosen]
    taken = {x for g in injected for x in g}
    kept, loose = [], []
    for g in receiver.items:
        if taken.isdisjoint(g):
            kept.append(list(g))
        else:
            loose += [x for x in g if x not in taken]
    child = Bins.of(donor.length, donor.capacity, [list(g) for g in injected] + kept)
    child.best_fit(child.swap_in(loose))
    return child


def mutate(one: Bins, rng: np.random.Generator) -> Bins:
    """Dissolve the least filled bins and a few others."""
    order = np.argsort(one.fill, kind="stable")
    gone = set(order[: max(1, len(order) // 50)].tolist()) | set(rng.integers(0, len(order), max(1, len(order) // 50)).tolist())
    out = Bins.of(one.length, one.capacity, [list(g) for i, g in enumerate(one.items) if i not in gone])
    out.best_fit(out.swap_in([x for i in sorted(gone) for x in one.items[i]]))
    return out


def least_bins(length: list[int], capacity: int) -> int:
    """A lower bound (Martello and Toth): pieces over half a bin cannot share one; what they leave of room takes the others.

    For each size k: pieces over capacity - k stand alone, those over a half have a bin each, and those from k to a half go
    into what room these leave, and then into more bins.
    """
    if not len(length):
        return 0
    count = np.bincount(np.asarray(length, np.int64), minlength=capacity + 1)
    upto = np.concatenate([[0], np.cumsum(count)])  # pieces shorter than i
    total = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    half = capacity // 2 + 1  # the shortest that is over a half
    k = np.arange(0, capacity // 2 + 1)
    large = upto[-1] - upto[half]
    room = (upto[capacity - k + 1] - upto[half]) * capacity - (total[capacity - k + 1] - total[half])
    small = total[half] - total[k]
    return int((large + np.maximum(0, -(-(small - room) // capacity))).max())


def evolve(length: list[int], capacity: int, solutions: list[list[int]], seed: int, generations: int, size: int = 4) -> Bins:
    """The best of a small population, from the given solutions (labels by item) and best-fit ones."""
    rng = np.random.default_rng(seed)
    least = least_bins(length, capacity)
    pool = [Bins.of(length, capacity, groups_of(s)) for s in solutions]
    while len(pool) < size:  # best fit after a random share, so that the population differs
        b, some = Bins(length, capacity), rng.random(len(length)) < 0.3
        b.best_fit(np.flatnonzero(some).tolist())
        b.best_fit(np.flatnonzero(~some).tolist())
        pool.append(b)
    pool.sort(key=Bins.rank)
    for _ in range(generations):
        if len(pool[0].items) <= least:
            break
        a, b = rng.choice(min(size, len(pool)), 2, replace=False)
        child = mutate(crossover(pool[a], pool[b], rng), rng)
        if len(pool) < size or child.rank() < pool[-1].rank():
            pool = sorted([*pool, child], key=Bins.rank)[:size]
    return pool[0]


SOLVED = "block long, island int, labels array<int>, bins long, least long, fitness double"


def _solved(block: int, island: int, best: Bins) -> pa.Table:
    return pa.table({"block": pa.array([block], pa.int64()), "island": pa.array([island], pa.int32()), "labels": pa.array([best.labels()], pa.list_(pa.int32())), "bins": pa.array([len(best.items)], pa.int64()), "least": pa.array([least_bins(best.length, best.capacity)], pa.int64()), "fitness": pa.array([best.fitness()])})


def _first(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        b = Bins(table.column("lengths")[0].as_py(), capacity)
        b.best_fit(list(range(len(b.length))))
        return _solved(table.column("block")[0].as_py(), -1, b)

    return run


def _epoch(capacity: int, generations: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        block, island = table.column("block")[0].as_py(), table.column("island")[0].as_py()
        given = [x for c in ("own", "guest") if (x := table.column(c)[0].as_py())]
        return _solved(block, island, evolve(table.column("lengths")[0].as_py(), capacity, given, seed + 1009 * block + 31 * island, generations))

    return run


def _placed(table: pa.Table) -> pa.Table:
    """(pid, bin, offset, fill) of one block's best solution, in the order of the pieces."""
    block = table.column("block")[0].as_py()
    pids, lengths, labels = (np.array(table.column(c)[0].as_py(), np.int64) for c in ("pids", "lengths", "labels"))
    order = np.lexsort((pids, labels))
    pids, lengths, labels = pids[order], lengths[order], labels[order]
    before = np.cumsum(lengths) - lengths
    first = np.ones(len(labels), bool)
    first[1:] = labels[1:] != labels[:-1]
    start = before[np.maximum.accumulate(np.where(first, np.arange(len(labels)), 0))]
    fill = np.bincount(labels, weights=lengths).astype(np.int64)[labels]
    return pa.table({"pid": pids, "block": np.full(len(pids), block), "bin": labels, "offset": before - start, "fill": fill})


def _evolved(sizes: DataFrame, first: DataFrame, capacity: int, islands: int, epochs: int, generations: int, seed: int) -> DataFrame:
    """The solutions of all islands of the blocks of first, after the last epoch; first leads island 0."""
    state = first.select("block", F.lit(0).alias("island"), "labels")
    isles = first.join(sizes, "block").select("block", "lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    for epoch in range(epochs):
        own, guests = state.withColumnRenamed("labels", "own"), state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("labels").alias("guest"))
        dealt = isles.join(own, ["block", "island"], "left").join(guests, ["block", "island"], "left").select("block", "island", "lengths", "own", "guest")
        nxt = cut(dealt.groupBy("block", "island").applyInArrow(tidied(_epoch(capacity, generations, seed + 7 * epoch)), SOLVED), "packing")
        release(state)
        state = reads(nxt.select("block", "island", "labels"), nxt)
    return nxt


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, islands: int = 2, epochs: int = 2, generations: int = 20, block: int = BLOCK, saving: float = 0.001, seed: int = 11) -> DataFrame:
    """(pid, sequence_id, offset) for pieces (pid, length), lengths from 1 to capacity; pids are distinct.

    At every size: blocks of about ``block`` pieces, and levels until one block is left or a level saves less than the share
    ``saving`` of the bins that it was given.  0 goes on while any bin is saved.
    """
    prepare(pieces.sparkSession)
    done = pieces.where(F.col("length") >= capacity).select("pid", (-F.col("pid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(F.col("length") < capacity).select("pid", "length")
    n, level, given = left.count(), 0, None
    while n:
        blocks = max(1, round(n / block))
        keyed = left.withColumn("block", F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(blocks)))
        sizes = keyed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pid", "length"))).alias("x")).select("block", F.col("x.pid").alias("pids"), F.col("x.length").alias("lengths"))
        sizes = cut(sizes, "packing")
        first = cut(sizes.groupBy("block").applyInArrow(tidied(_first(capacity)), SOLVED), "packing")
        tables, solved, over = [first], first, first.where("bins > least")
        if epochs and over.limit(1).count():
            tables.append(_evolved(sizes, over, capacity, islands, epochs, generations, seed))
            solved = first.unionByName(tables[-1])
        best = solved.groupBy("block").agg(F.min_by("labels", F.struct("bins", -F.col("fitness"), "island")).alias("labels"))
        placed = cut(sizes.join(best, "block").groupBy("block").applyInArrow(tidied(_placed), "pid long, block long, bin long, offset long, fill long"), "packing")
        for table in (sizes, *tables):
            release(table)
        level, full = level + 1, F.col("fill") >= FULL * capacity
        number = F.lit(level).cast("long") * F.lit(1 << 56) + F.col("block") * F.lit(1 << 24) + F.col("bin")
        last = blocks == 1 or (given is not None and placed.where("offset = 0").count() > (1 - saving) * given)
        done = done.unionByName(placed.where(F.lit(True) if last else full).select("pid", number.alias("sequence_id"), "offset"))
        if last:
            break
        given = placed.where(~full & (F.col("offset") == 0)).count()
        before, left = left, cut(placed.where(~full).select("pid").join(left, "pid"), "packing")
        release(before)
        n = left.count()
    return done


def pack_documents(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, with_ids: bool = False, remember: tuple[int, int] = REMEMBER, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of docs (doc_id, text, ...).

    A document is its ids followed by ``end``; null and empty texts are the end alone.  Longer ones, of any length, are cut
    into pieces of ``capacity``.  Of solutions with equally few bins the one with fuller bins is taken, then that of the first
    island; in best fit longer pieces come first, then those that the scan met first.  Repeated rows and rows without doc_id are packed each for itself; extra columns are
    ignored; an empty table gives an empty result.  ``path`` is a tokenizer file that every executor can read; ``remember``, how
    many chunks and words a worker keeps, trades its memory for time and changes no result.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, end, capacity, with_ids, remember), schema).withColumn("pid", F.monotonically_increasing_id()), "packing")
    return pieces.join(pack_lengths(pieces.select("pid", "length"), capacity, **how), "pid").drop("pid")
