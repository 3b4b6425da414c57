"""Operator 6: exact Jaccard join of word shingles by size-banded tiles and bitmap signatures.

1.  One scan counts, for every document, its shingles and a fingerprint of the set, and adds up
    sketches of how often shingles and words occur (2**20 counters each, over all documents).
2.  A second scan emits each document's prefix: its ``n - ceil(t n) + c`` shingles that come first in
    one order of all shingles, c being 4 and a 32nd of n.  Two documents that link must share c of
    them, whatever the order, so nothing is lost; the order, from the sketches, only keeps shingles that
    many documents share, or that consist of common words, out of the prefixes.
3.  Pairs of documents that share a rare entry are counted.  Through entries that more than eight share,
    only documents with at least c such entries are linked, each to one head for its entry and band.
    The components of both hold every link.
4.  Each component is cut into tiles of one size band and bounded weight.  A third scan makes the sorted arrays of
    its sets only (a Bloom filter of bounded size keeps most other documents from the shuffle).  Pairs of tiles of
    equal or neighbouring bands are compared: bitmaps bound the overlap from above by
    ``(|A| + |B| - popcount(a xor b)) / 2``, then sorted arrays are intersected exactly.  Documents
    that are already joined inside a tile pair are not compared again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import bloom, components, contracted, cut, in_bloom, mix64, numbered_words, parallelism, prepare, reads, release, slices, tidied

SKETCH_BITS = 20
BLOCK = 4096
#: Most documents and shingles in one tile.
TILE_DOCS, TILE_SHINGLES = 4096, 3_000_000
#: Documents up to which an entry's pairs are counted.
CROWD = 8
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def hashed_words(column: pa.Array, memo: WordHashes) -> list[np.ndarray]:
    """The hashed words of each text: A-Z in lower case, split at [\x20\x09-\x0D]."""
    numbers, bounds, words = numbered_words(pc.ascii_lower(column), ascii_only=True)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return np.split(hashes[numbers], bounds[1:-1]) if len(bounds) > 1 else []


def rolled(w: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles in order; the whole text is one if it has fewer words."""
    if not len(w):
        return w
    width = min(k, len(w))
    with np.errstate(over="ignore"):
        h = w[: len(w) - width + 1] + np.uint64(width)
        for i in range(1, width):
            h = h * STEP + w[i : len(w) - width + 1 + i]
    return mix64(h)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def fingerprint(s: np.ndarray) -> int:
    """128 bits of a sorted set of shingles."""
    return xxhash.xxh3_128_intdigest(s.tobytes())


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    fps = [fingerprint(s) for s in sets]
    return np.array([f & 0xFFFFFFFFFFFFFFFF for f in fps], np.uint64), np.array([f >> 64 for f in fps], np.uint64)


def _survey(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp_a", pa.int64()), ("fp_b", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, size = WordHashes(), 1 << SKETCH_BITS
        sketch = np.zeros(2 * size, np.int64)  # of shingles, and of words
        for batch in slices(batches):
            spoken = hashed_words(batch.column("text"), memo)
            found = [distinct(rolled(w, k)) for w in spoken]
            for half, every in ((0, found), (size, spoken)):
                if every:
                    np.add.at(sketch, half + counter_of(np.concatenate(every)), 1)
            low, high = _fingerprints(found)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), _long(low), _long(high), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        blocks = [b for b in range(len(sketch) // BLOCK) if sketch[b * BLOCK : (b + 1) * BLOCK].any()]
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 4 + [pa.array(blocks, pa.int32()), pa.array([_packed(sketch[b * BLOCK : (b + 1) * BLOCK]) for b in blocks], pa.binary())], schema=schema)

    return run


def _packed(counts: np.ndarray) -> bytes:
    """One block of counters, small: most are far below 2**64."""
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), "<i8")


def _add_blocks(table: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in table.column("counts"):
        total += _unpacked(x.as_py())
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "counts": pa.array([_packed(total)], pa.binary())})


def _levels(sketch: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each counter, how far its shingles are above the mean, and how often its words occur, in powers of two.

    2**20 bytes each, whatever the corpus.
    """
    kind = "block int, counts binary"
    parts = sketch.groupBy("block", "salt").applyInArrow(_add_blocks, kind)
    rows = parts.groupBy("block").applyInArrow(_add_blocks, kind).collect()  # at most 512 rows of 4096 counters
    total = np.zeros(2 << SKETCH_BITS, np.float64)
    for r in rows:
        total[r.block * BLOCK : (r.block + 1) * BLOCK] = _unpacked(bytes(r.counts))
    found, spoken = total[: 1 << SKETCH_BITS], total[1 << SKETCH_BITS :]
    mean = max(found.mean(), 1.0)
    above = np.floor(2 * np.log2(np.maximum(found, mean) / mean))
    return np.minimum(above, 100).astype(np.uint8), np.floor(np.log2(np.maximum(spoken, 1))).astype(np.uint8)


def in_order(w: np.ndarray, k: int, levels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The distinct shingles of a text in the global order: (level of the shingle, commonness of its words, hash)."""
    above, spoken = levels
    h = rolled(w, k)
    own, width = spoken[counter_of(w)].astype(np.int64), min(k, len(w))
    common = sum(own[i : len(w) - width + 1 + i] for i in range(width))
    order = np.argsort(h)
    h, common = h[order], common[order]
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    h, common = h[keep], common[keep]
    key = above[counter_of(h)].astype(np.int64) * 1024 + common
    return h[np.argsort(key, kind="stable")]


def common_entries(n: int) -> int:
    """Entries that the prefixes of two documents that link must have in common, if theirs are long enough."""
    return 4 + n // 32


def bands(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of two sets that may link lie in equal or neighbouring bands."""
    return np.floor(np.log(np.maximum(n, 1)) / -np.log((percent - 0.1) / 100)).astype(np.int64)


def _prefixes(k: int, percent: int, levels):
    """(hash, band, id, need, crowd): a set's prefix, long enough for ``need`` common entries with any set it links with.

    id is half of the set's fingerprint, so copies have one id wherever they lie; sets that share it by chance only become
    candidates of each other's candidates.

    crowd: 0, or 1 where more than CROWD documents of the batch share the entry, and a 2 without id for each such entry.
    """
    schema = pa.schema([("hash", pa.int64()), ("band", pa.int32()), ("id", pa.int64()), ("need", pa.int32()), ("crowd", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, level = WordHashes(), levels.value
        for batch in slices(batches):
            seen: set[int] = set()
            ids, hashes, sizes, needs = [], [], [], []
            for doc, w in zip(batch.column("doc_id").to_pylist(), hashed_words(batch.column("text"), memo), strict=True):
                if doc is None or not len(w):
                    continue
                s = in_order(w, k, level)
                if (same := fingerprint(np.sort(s))) in seen:
                    continue  # copies of one set are linked by their fingerprints
                seen.add(same)
                least = (percent * len(s) + 99) // 100
                need = min(common_entries(len(s)), least)
                p = len(s) - least + need
                hashes.append(s[:p])
                ids.append(np.full(p, same & 0xFFFFFFFFFFFFFFFF, np.uint64).view(np.int64))
                for values, x in ((sizes, len(s)), (needs, need)):
                    values.append(np.full(p, x, np.int64))
            if not ids:
                continue
            h, i, b, need = np.concatenate(hashes), np.concatenate(ids), bands(np.concatenate(sizes), percent), np.concatenate(needs)
            order = np.argsort(h, kind="stable")
            h, i, b, need = h[order], i[order], b[order], need[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            crowd = np.diff(np.append(np.flatnonzero(first), len(h)))[np.cumsum(first) - 1] > CROWD
            yield pa.RecordBatch.from_arrays([_long(h), pa.array(b, pa.int32()), pa.array(i), pa.array(need, pa.int32()), pa.array(crowd.astype(np.int32))], schema=schema)
            marks = h[first & crowd]
            if len(marks):
                zero = pa.array(np.zeros(len(marks), np.int32))
                yield pa.RecordBatch.from_arrays([_long(marks), zero, pa.nulls(len(marks), pa.int64()), zero, pa.array(np.full(len(marks), 2, np.int32))], schema=schema)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From entries, those not yet known to be large sorted by (hash, band, id): for entries of at most CROWD documents all pairs (kind 0: a, b = documents,
    c = entries in common, d = need); for larger ones their rows (kind 1: a = hash, b = document, c = band, d = need).
    """
    held: list[np.ndarray] = []

    def rows(kind: int, a, b, c, d) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32))] + [pa.array(x.astype(np.int64)) for x in (a, b, c, d)], names=["kind", "a", "b", "c", "d"])

    def out(h, b, i, need, crowd) -> Iterator[pa.RecordBatch]:
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        group = np.cumsum(first) - 1
        large = ((np.bincount(group) > CROWD) | (np.bincount(group, weights=crowd) > 0))[group]
        x = large & (crowd == 0)
        yield rows(1, h[x], i[x], b[x], need[x])
        small = ~large
        h, b, i, need = h[small], b[small], i[small], need[small]
        found = []
        for step in range(1, min(CROWD, len(h))):
            at = np.flatnonzero((h[step:] == h[:-step]) & (b[step:] - b[:-step] <= 1) & (i[step:] != i[:-step]))
            found.append(np.stack([np.minimum(i[at], i[at + step]), np.maximum(i[at], i[at + step]), np.minimum(need[at], need[at + step])], 1))
        if not found:
            return
        x = np.concatenate(found)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:, :2] != x[:-1, :2]).any(1)
        at = np.flatnonzero(new)
        yield rows(0, x[at, 0], x[at, 1], np.diff(np.append(at, len(x))), x[at, 2])

    for batch in batches:
        every = np.stack([pc.fill_null(batch.column(c), -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("hash", "band", "id", "need", "crowd")])
        known = every[4] == 1  # known to be of a large entry, whose other rows lie elsewhere
        if known.any():
            h, b, i, need, _ = every[:, known]
            yield rows(1, h, i, b, need)
        if known.all():
            continue
        held.append(every[:, ~known])
        if sum(x.shape[1] for x in held) < 300_000:
            continue
        every = np.concatenate(held, 1)
        last = int(np.searchsorted(every[0], every[0, -1]))
        if last:
            yield from out(*every[:, :last])
            held = [every[:, last:]]
        elif every.shape[1] > 1_000_000:  # one entry fills it all: its rows pass, and a mark says so to those that follow
            yield from out(*every)
            mark = every[:, -1:].copy()
            mark[4] = 2
            held = [mark]
        else:
            held = [every]
    if held:
        yield from out(*np.concatenate(held, 1))


def _candidates(docs: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """(src, dst), halves of fingerprints: links, not all pairs, whose components hold every link between different sets.

    A pair that links has ``need`` entries in common.  If one of them is rare, the pair is counted, and what it may have in
    common of frequent entries is bounded by how many of them each document has.  If all are frequent, both documents
    have ``need`` frequent entries; only such documents are linked through frequent entries, each to one document for its
    entry and band.
    """
    spark = docs.sparkSession
    entries = docs.mapInArrow(_prefixes(k, percent, levels), "hash long, band int, id long, need int, crowd int")
    # what a batch already knows to be large needs no other rows of its entry: it is dealt evenly
    dealt = F.when(F.col("crowd") == 1, F.xxhash64("hash", "id")).otherwise(F.col("hash"))
    met = cut(entries.repartition(parallelism(spark), dealt).sortWithinPartitions("hash", "band", "id").mapInArrow(_met, "kind int, a long, b long, c long, d long"), "jaccard")
    frequent = met.where("kind = 1").select(F.col("a").alias("hash"), F.col("b").alias("id"), F.col("c").cast("int").alias("band"), F.col("d").alias("need"))
    per_doc = cut(frequent.groupBy("id").agg(F.count("*").alias("n"), F.min("need").alias("need")), "jaccard")
    pairs = met.where("kind = 0").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("c").alias("common"), F.min("d").alias("need"))
    of = lambda end: per_doc.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"))
    known = pairs.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    rare = known.where(F.col("common") + F.least(F.coalesce("n_src", F.lit(0)), F.coalesce("n_dst", F.lit(0))) >= F.col("need"))
    crowded = frequent.join(per_doc.where("n >= need").select("id"), "id", "left_semi").select("hash", "band", "id")
    heads = cut(crowded.groupBy("hash", "band").agg(F.min("id").alias("head")), "jaccard")
    members = crowded.join(heads, ["hash", "band"]).select(F.col("id").alias("src"), F.col("head").alias("dst"))
    above = heads.select("hash", (F.col("band") - 1).alias("band"), F.col("head").alias("src"))
    found = rare.select("src", "dst").unionByName(members.where("src <> dst")).unionByName(heads.join(above, ["hash", "band"]).select("src", F.col("head").alias("dst")))
    edges = cut(contracted(found), "jaccard")
    for table in (met, per_doc, heads):
        release(table)
    return edges


def _tile_links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one pair of tiles; with one tile only, side is all 0."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, n))
    ids, side, sets, n = ids[order], side[order], [sets[x] for x in order], n[order]
    two = bool(side.any()) and not side.all()
    width = 1 << max(6, int(2 * n[-1] - 1).bit_length())
    width = min(width, 1 << 15)
    bits = np.zeros((len(sets), width // 64), np.uint64)
    for r, s in enumerate(sets):
        x = (s >> np.uint64(20)) & np.uint64(width - 1)
        np.bitwise_or.at(bits[r], (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
    label, found = np.arange(len(sets)), []
    for r in range(len(sets) - 1):
        stop = int(np.searchsorted(n, n[r] * 100 // percent, side="right"))
        todo = np.arange(r + 1, stop)
        todo = todo[label[todo] != label[r]]
        if two:
            todo = todo[side[todo] != side[r]]
        for start in range(0, len(todo), 512):
            part = todo[start : start + 512]
            differ = np.bitwise_count(bits[part] ^ bits[r]).sum(1, dtype=np.int64)
            most = np.minimum((n[part] + n[r] - differ) // 2, n[r])
            for c in part[100 * most >= percent * (n[part] + n[r] - most)]:
                if label[c] == label[r]:
                    continue
                at = np.searchsorted(sets[c], sets[r])
                at[at == len(sets[c])] = 0
                both = int((sets[c][at] == sets[r]).sum())
                if 100 * both >= percent * (n[r] + n[c] - both):
                    found.append((int(ids[r]), int(ids[c])))
                    label[label == label[c]] = label[r]
    return found


def _key() -> Column:
    return F.xxhash64("doc_id")


def _sets(k: int, wanted):
    """(fp_a, fp_b, doc_id, shingles) of the rows (doc_id, text, key) that pass the filter; repeated ones of a slice come once."""
    schema = pa.schema([("fp_a", pa.int64()), ("fp_b", pa.int64()), ("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (bits, known) = WordHashes(), wanted.value
        passed = (b.filter(pa.array(in_bloom(b.column("key").to_numpy(), bits, known))) for b in batches)
        for batch in slices(passed):
            doc = batch.column("doc_id").to_numpy()
            found = [distinct(rolled(w, k)) for w in hashed_words(batch.column("text"), memo)]
            low, high = _fingerprints(found)
            at = np.unique(np.stack([low, high, doc.view(np.uint64)], 1), axis=0, return_index=True)[1]
            at = at[[len(found[i]) > 0 for i in at]]
            yield pa.RecordBatch.from_arrays([_long(low[at]), _long(high[at]), pa.array(doc[at]), pa.array([found[i].view(np.int64) for i in at], pa.list_(pa.int64()))], schema=schema)

    return run


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        comp, ids, side, low = (table.column(c).to_numpy() for c in ("comp", "doc_id", "side", "fp_a"))
        lists = table.column("shingles").combine_chunks()
        flat, starts = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(lists.offsets)
        order = np.lexsort((side, ids, low, comp))
        same = np.zeros(len(order), bool)  # rows that repeat a document come more than once
        for x in (comp, ids, low, side):
            same[1:] += x[order][1:] != x[order][:-1]
        order = order[same | (np.arange(len(order)) == 0)]
        out: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.diff(comp[order])) + 1
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                out += _tile_links(ids[rows], side[rows], [flat[starts[x] : starts[x + 1]] for x in rows], percent)
        return pa.table({"src": pa.array([x[0] for x in out], pa.int64()), "dst": pa.array([x[1] for x in out], pa.int64())})

    return run


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """(fp_a, fp_b, doc_id, comp, task, side): which comparisons each set takes part in.

    Components of one tile share tasks; larger ones get a task for each pair of tiles of equal or neighbouring bands.
    """
    spark = members.sparkSession
    width = -float(np.log((percent - 0.1) / 100))
    m = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long"))
    weight = F.greatest(F.col("docs") / TILE_DOCS, F.col("w") / TILE_SHINGLES)
    per_band = m.groupBy("comp", "band").agg(F.count("*").alias("docs"), F.sum("n").alias("w"))
    whole = per_band.groupBy("comp").agg(F.sum("docs").alias("docs"), F.sum("w").alias("w")).where("docs > 1").select("comp", weight.alias("load"))
    packs = max(parallelism(spark), int((whole.where("load <= 1").agg(F.sum("load")).first()[0] or 0) * 8))
    small = m.join(whole.where("load <= 1").select("comp"), "comp").select("fp_a", "fp_b", "doc_id", "comp", F.concat(F.lit("p"), F.pmod(F.xxhash64("comp"), F.lit(packs))).alias("task"), F.lit(0).alias("side"))
    large = per_band.join(whole.where("load > 1").select("comp"), "comp").withColumn("tiles", F.ceil(weight * 1.2).cast("long")).select("comp", "band", "tiles")
    tile = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select("comp", "band", "salt")
    a, b = tile.alias("a"), tile.select("comp", F.col("band").alias("band_b"), F.col("salt").alias("salt_b"))
    pairs = a.join(b, "comp").where("band_b = band and salt_b >= salt or band_b = band + 1").withColumn("task", F.concat_ws("-", F.lit("t"), "comp", "band", "salt", "band_b", "salt_b"))
    sides = pairs.select("comp", "band", "salt", "task", F.lit(0).alias("side")).unionByName(pairs.where("band_b <> band or salt_b <> salt").select("comp", F.col("band_b").alias("band"), F.col("salt_b").alias("salt"), "task", F.lit(1).alias("side")))
    docs = m.join(large, ["comp", "band"]).withColumn("salt", F.pmod(F.xxhash64("fp_a", "fp_b"), F.col("tiles")))
    return small.unionByName(docs.join(sides, ["comp", "band", "salt"]).select("fp_a", "fp_b", "doc_id", "comp", "task", "side"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text, ...).

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles, which is
    exact but for 64-bit hashes.  Null and empty texts, and texts of white space, have no shingles and link with
    nothing.  Texts of any length are read whole.  Rows with one doc_id are one node that has the links of all its texts; a
    null doc_id links with nothing and is its own component (null).  Ties do not arise: a component is named by its smallest
    doc_id.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = cut(docs.mapInArrow(_survey(k), "doc_id long, n long, fp_a long, fp_b long, block int, counts binary"), "jaccard")
    sets = survey.where("block is null").select("doc_id", "n", "fp_a", "fp_b")
    levels = spark.sparkContext.broadcast(_levels(survey.where("block is not null").select("block", "counts", F.pmod(F.spark_partition_id(), F.lit(16)).alias("salt"))))
    edges = _candidates(docs, k, percent, levels)
    candidates = components(edges)
    release(edges)
    # a class holds the rows of one set; it goes by its fingerprint, as classes may share their smallest doc_id
    classes = sets.where("n > 0 and doc_id is not null").groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"))
    members = cut(classes.join(candidates, classes["fp_a"] == candidates["id"]).select(F.col("component_id").alias("comp"), "fp_a", "fp_b", F.col("rep").alias("doc_id"), "n"), "jaccard")
    release(candidates)
    arrays = docs.where("doc_id is not null").withColumn("key", _key()).mapInArrow(_sets(k, spark.sparkContext.broadcast(bloom(members.select(_key().alias("key")), "key"))), "fp_a long, fp_b long, doc_id long, shingles array<long>")
    found = arrays.join(_tiles(members, percent), ["fp_a", "fp_b", "doc_id"]).select("task", "comp", "side", "fp_a", "doc_id", "shingles").groupBy("task").applyInArrow(tidied(_compare(percent)), "src long, dst long")
    copies = sets.where("n > 0 and doc_id is not null").join(classes.where("copies > 1").select("fp_a", "fp_b", "rep"), ["fp_a", "fp_b"]).where("doc_id <> rep").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst"))
    final = components(found.unionByName(copies))
    release(members)
    out = sets.join(final, sets["doc_id"] == final["id"], "left").select(sets["doc_id"], F.col("n").alias("n_shingles"), F.coalesce("component_id", sets["doc_id"]).alias("component_id"))
    return reads(out, survey, final)
