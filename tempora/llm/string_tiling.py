"""Operator 9: benchmark decontamination by greedy string tiling.

1.  Windows of ``least`` words of every benchmark item are hashed (Karp-Rabin); windows of a document that share a hash,
    and the words, are its seeds.  The items are broadcast if their texts are within BROADCAST_BYTES, which is checked;
    beyond it, documents and items meet in a join on hashes.  An item can only be covered if a share of its windows occurs,
    so the most frequent windows of each item are left out of that join.
2.  For each document and item with seeds enough to cover it, maximal matches are grown from the seeds; the longest that is
    free on both sides is marked, the rest are cut down to what is still free, and so on until no match of ``least``
    words is left.  Repetitive texts with more than MOST_SEEDS seeds are tiled by running Karp-Rabin over windows of the
    longest length first, which needs memory for the two texts only and marks the same.
    Tiles may come in any order, so reordered passages are caught.
3.  Items of which at least ``cover`` is marked count as leaked.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import prepare, slices

WORD = re.compile(r"\w+")
LEAST, COVER = 4, 0.5
#: Most bytes of benchmark texts that are broadcast, and seeds of a document and an item that are listed.
BROADCAST_BYTES, MOST_SEEDS = 8 << 20, 200_000
BASE = np.uint64(0x100000001B3)
SCHEMA = "doc_id long, item_id long, coverage double, matched long, longest long, tiles long"
KINDS = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("matched", pa.int64()), ("longest", pa.int64()), ("tiles", pa.int64())]


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of ids (uint64), each rolled one word further than the last."""
    if len(ids) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(ids) - width + 1, np.uint64)
        for i in range(width):
            h = h * BASE + ids[i : len(ids) - width + 1 + i]
    return h


class Vocabulary(dict):
    """Numbers of the benchmark's words; 0 for any other word."""

    def __missing__(self, word: str) -> int:
        return 0


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Items:
    """The benchmark's items as word numbers, and their windows sorted by hash."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.least, self.vocabulary = least, Vocabulary()
        self.ids, self.names = [], []
        hashes, owner, place = [], [], []
        for name, text in rows:
            found = words(text)
            if name is None or len(found) < least:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.uint64)
            h = windows(ids, least)
            owner.append(np.full(len(h), len(self.ids)))
            place.append(np.arange(len(h)))
            hashes.append(h)
            self.ids.append(ids)
            self.names.append(name)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.concatenate(owner)[order] if hashes else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if hashes else np.empty(0, np.int64)

    def _met(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of windows of the document that may be known, first in self.hashes, how many there)."""
        h = windows(doc, self.least)
        known = np.concatenate([[0], np.cumsum(doc == 0)])
        at = np.flatnonzero(known[self.least :] == known[: len(known) - self.least]) if len(h) else np.empty(0, np.int64)
        low = np.searchsorted(self.hashes, h[at], "left")
        n = np.searchsorted(self.hashes, h[at], "right") - low
        return at[n > 0], low[n > 0], n[n > 0]

    def coverable(self, low: np.ndarray, n: np.ndarray, cover: float) -> np.ndarray:
        """Items of which windows in common with a document cover enough; each distinct window is looked at once."""
        low, first = np.unique(low, return_index=True)
        n = n[first]
        rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, place = self.owner[rows], self.place[rows]
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        gain = np.full(len(item), self.least)  # words that a window covers beyond the one before it
        near = item[1:] == item[:-1]
        gain[1:][near] = np.minimum(self.least, np.diff(place)[near])
        total = np.bincount(item, weights=gain, minlength=len(self.ids))
        found = np.unique(item)
        return found[total[found] >= cover * np.array([len(self.ids[i]) for i in found])]

    def tile(self, doc: np.ndarray, cover: float) -> list[tuple[int, float, int, int, int]]:
        at, low, n = self._met(doc)
        out = []
        if not len(at):
            return out
        some = self.coverable(low, n, cover)
        if not len(some):
            return out
        if n.sum() <= MOST_SEEDS:
            rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, p, d = self.owner[rows], self.place[rows], np.repeat(at, n)
        for i in some.tolist():
            ids = self.ids[i]
            if n.sum() <= MOST_SEEDS:
                tiles = greedy_tiles(ids, doc, p[item == i], d[item == i], self.least)
            else:
                tiles = running_tiles(ids, doc, self.least)
            if (matched := sum(tiles)) >= cover * len(ids):
                out.append((self.names[i], matched / len(ids), matched, max(tiles), len(tiles)))
        return out


def greedy_tiles(item: np.ndarray, doc: np.ndarray, p: np.ndarray, d: np.ndarray, least: int) -> list[int]:
    """Lengths of the tiles: the longest match that is free on both sides is marked first."""
    same = np.ones(len(p), bool)
    for i in range(least):  # equal hashes may stand for other words
        same &= item[p + i] == doc[d + i]
    p, d = p[same], d[same]
    diagonal = d.astype(np.int64) - p
    order = np.lexsort((p, diagonal))
    p, d, diagonal = p[order], d[order], diagonal[order]
    # a run of seeds side by side on one diagonal is one maximal match
    first = np.ones(len(p), bool)
    first[1:] = (np.diff(diagonal) != 0) | (np.diff(p) != 1)
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(p))) + least - 1
    queue = list(zip((-length).tolist(), p[start].tolist(), d[start].tolist(), strict=True))
    heapq.heapify(queue)
    item_free, doc_used, tiles = np.ones(len(item), bool), set(), []
    while queue:
        n, a, b = heapq.heappop(queue)
        n = -n
        free = [item_free[a + i] and b + i not in doc_used for i in range(n)]
        if all(free):
            item_free[a : a + n] = False
            doc_used.update(range(b, b + n))
            tiles.append(n)
            continue
        i = 0
        while i < n:  # what is still free of it goes back
            if not free[i]:
                i += 1
                continue
            j = i
            while j < n and free[j]:
                j += 1
            if j - i >= least:
                heapq.heappush(queue, (i - j, a + i, b + i))
            i = j
    return tiles


def running_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[int]:
    """The same tiles by search lengths: Karp-Rabin windows of the longest length that free stretches of both have in common."""
    free_item, free_doc, tiles = np.ones(len(item), bool), np.ones(len(doc), bool), []

    def common(width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of free windows that both sides have, and the places of those of the item."""
        found = []
        for ids, free in ((item, free_item), (doc, free_doc)):
            taken = np.concatenate([[0], np.cumsum(~free)])
            at = np.flatnonzero(taken[width:] == taken[: len(taken) - width]) if len(ids) >= width else np.empty(0, np.int64)
            found.append((windows(ids, width)[at], at))
        both = np.isin(found[0][0], found[1][0])
        return found[0][1][both], both

    longest = min(len(item), len(doc))
    while True:
        low, high = least - 1, longest
        while low < high:  # a common window of some length has common windows of all shorter ones
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            return tiles
        longest, places = low, common(low)[0]
        h = windows(doc, longest)
        taken = np.concatenate([[0], np.cumsum(~free_doc)])
        order = np.argsort(h, kind="stable")
        order = order[taken[order + longest] == taken[order]]
        hashed, own, marked = h[order], windows(item, longest), False
        for a in places.tolist():
            if not free_item[a : a + longest].all():
                continue
            at = int(np.searchsorted(hashed, own[a]))
            while at < len(order) and hashed[at] == own[a]:
                b = int(order[at])
                if free_doc[b : b + longest].all() and (item[a : a + longest] == doc[b : b + longest]).all():
                    free_item[a : a + longest] = free_doc[b : b + longest] = False
                    tiles.append(longest)
                    marked = True
                    break
                at += 1
        if not marked:  # only hashes agreed
            longest -= 1


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, (_, k) in enumerate(KINDS)], names=[n for n, _ in KINDS])


def _found(known: Items, text: str | None, cover: float) -> list[tuple]:
    w = words(text)
    ids = np.fromiter(map(known.vocabulary.__getitem__, w), np.uint64, len(w))
    return known.tile(ids, cover) if np.count_nonzero(ids) >= known.least else []


def _against_all(items, cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            found = [(doc, *x) for doc, text in pairs if doc is not None for x in _found(items.value, text, cover)]
            if found:
                yield _rows(found)

    return run


def _flagged(items, cover: float, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            leaked = [bool(_found(items.value, text, cover)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(leaked, pa.bool_())], names=[*columns, "leaked"])

    return run


def _seeds(name: str, least: int, cover: float):
    """(id, hash, times, spare) for each distinct window of a text, whose hashes need no common numbering.

    spare: how many windows of a covered text may be missing from the other one.  Tiles have ``least`` words, so a text of
    which n words are in tiles has n / least of its windows there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, text in zip(batch.column(name).to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = np.array([xxhash.xxh64_intdigest(x) for x in words(text)], np.uint64)
                h, times = np.unique(windows(w, least), return_counts=True)
                if i is not None and len(h):
                    spare = int(np.ceil(cover * len(w) / least)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i)), pa.array(h.view(np.int64)), pa.array(times), pa.array(np.full(len(h), spare))], names=[name, "hash", "times", "spare"])

    return run


def _each_pair(least: int, cover: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for doc, name, text, passage in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "text", "passage")), strict=True):
                found += [(doc, *x) for x in _found(Items([(name, passage)], least), text, cover)]
            if found:
                yield _rows(found)

    return run


def _broadcast(benchmark: DataFrame, least: int, most: int):
    """The items, broadcast, if their texts have at most ``most`` bytes; else None."""
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    if benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0] > most:
        return None
    rows = sorted(tuple(r) for r in benchmark.collect())  # at most ``most`` bytes
    return benchmark.sparkSession.sparkContext.broadcast(Items(rows, least))


def leaked_items(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, cover: float = COVER, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, matched, longest, tiles) of each document and benchmark item it holds.

    coverage is the share of the item's words in tiles.  Words are runs of letters, digits and _, lower-cased; items with
    fewer than ``least`` words match nothing, and null or empty texts hold nothing; whole texts of any length are read.  Of
    matches of one length the first in the item, then in the document, is marked first.  Rows without an id are left out;
    repeated rows give repeated results; extra columns are ignored; empty tables give an empty result.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _broadcast(benchmark, least, broadcast_bytes)
    if items is not None:
        return docs.mapInArrow(_against_all(items, cover), SCHEMA)
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    kind = "hash long, times long, spare long"
    of_docs = docs.mapInArrow(_seeds("doc_id", least, cover), f"doc_id long, {kind}").select("doc_id", "hash")
    of_items = benchmark.mapInArrow(_seeds("item_id", least, cover), f"item_id long, {kind}").distinct()
    often = of_docs.join(of_items.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("n"))
    common_first = Window.partitionBy("item_id").orderBy(F.desc("n"), "hash").rowsBetween(Window.unboundedPreceding, 0)
    rare = of_items.join(often, "hash").withColumn("before", F.sum("times").over(common_first)).where(F.col("before") > F.col("spare"))
    pairs = of_docs.join(rare.select("hash", "item_id"), "hash").select("doc_id", "item_id").distinct()
    passages = benchmark.select("item_id", F.col("text").alias("passage")).distinct()
    return docs.join(pairs, "doc_id").join(passages, "item_id").mapInArrow(_each_pair(least, cover), SCHEMA)


def flag_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, cover: float = COVER, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) with leaked: whether they hold a benchmark item.  One narrow pass if the items can be broadcast.

    Rows are judged by their text alone, so rows without doc_id and unlike texts under one doc_id count too; a column ``leaked`` that
    docs have is replaced.  Beyond the broadcast each text is tiled once, however many rows repeat it.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("leaked")
    items = _broadcast(benchmark, least, broadcast_bytes)
    if items is not None:
        schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", leaked boolean"
        return docs.mapInArrow(_flagged(items, cover, docs.columns), schema)
    named = docs.withColumn("_key", F.xxhash64("text"))
    texts = named.select(F.col("_key").alias("doc_id"), "text").distinct()
    leaked = leaked_items(texts, benchmark, least, cover, broadcast_bytes).select(F.col("doc_id").alias("_key"), F.lit(True).alias("_leaked")).distinct()
    return named.join(leaked, "_key", "left").select(*docs.columns, F.coalesce("_leaked", F.lit(False)).alias("leaked"))
