"""Operator 5: main text by differencing each page with the page of the nearest URL on its host.

1.  Each page becomes text blocks, marked by their place: inside an article or main element, or inside what is
    set aside (menus, footers, forms, comments and the like).
2.  Pages are dealt in ranges of (host, path, page_id), by cut points from a bounded sample of the URLs; the ranges
    only lay out the work, and a host of any size spreads over as many of them as it needs.  A first scan finds the texts
    on both sides of every cut; the second hands them to the ranges that they border on, so the cuts change no result.
3.  Each page is paired with the pages around it in that order whose texts differ from its own, the longest common
    beginning of the paths first; their blocks are aligned by a longest common subsequence.  A shared block is deleted
    unless it is main text by its place; one that is mostly links goes even there.
4.  Pages of one text are copies, however many lie between a page and the next other text.  A page that shares most of
    its body may be an edited copy or a short article among long menus: further pages are tried, and only where no page
    shares less, what the page shares with two others goes, if either leaves it words of its own that the other lacks.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import parallelism, prepare, slices
from tempora.llm.html_text import Block, blocks

#: URLs that lay out the ranges, bytes of pages for a range, and most ranges.
SAMPLE, RANGE_BYTES, MOST_RANGES = 20_000, 16 << 20, 20_000
#: Rows that are looked at together within a range.
TOGETHER = 2000
#: Different texts of the host that a page is held against on each side, nearest first.
REACH = 4
#: Words that a page must keep to count as different from one with which it shares most of its body.
OWN_WORDS = 3


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL, lower-case host without www., path without a closing slash or file ending."""
    try:
        u = urlsplit((url or "").strip())
        host, path = (u.hostname or "").removeprefix("www."), u.path
    except ValueError:
        return "", url or ""
    path = path.rstrip("/")
    for ending in (".html", ".htm", ".php", ".aspx"):
        path = path.removesuffix(ending)
    return host, path or "/"


def common_beginning(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices in a of a longest common subsequence of a and b (by matching pairs and an increasing run)."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    where: dict[str, list[int]] = {}
    for j in range(head, len(b) - tail):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    nodes: list[tuple[int, tuple | None]] = []
    for i in range(head, len(a) - tail):
        for j in reversed(where.get(a[i], ())):
            at = bisect_left(ends, j)
            node = (i, nodes[at - 1] if at else None)
            if at == len(ends):
                ends.append(j)
                nodes.append(node)
            else:
                ends[at], nodes[at] = j, node
    found = set(range(head)) | set(range(len(a) - tail, len(a)))
    node = nodes[-1] if nodes else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def main_text(own: list[Block], near: list[list[Block]]) -> str:
    """The main text of a page, given the blocks of other pages of its host, the nearest first."""
    placed = any(b.main and not b.aside for b in own)
    kept = [not b.aside and (b.main or not placed) for b in own]
    body = [i for i, k in enumerate(kept) if k]
    texts = [b.text for b in own]
    whole = sum(len(texts[i]) for i in body)
    mostly: list[tuple[int, set[int]]] = []
    shared: set[int] = set()
    for other in near:
        found = shared_lines(texts, [b.text for b in other])
        copied = sum(len(texts[i]) for i in body if i in found)
        if 2 * copied <= whole or len(found) < 2:
            shared = found
            break
        rest = " ".join(texts[i] for i in body if i not in found)
        if len(rest.split()) >= OWN_WORDS:
            mostly.append((copied, found))
    else:
        if len(mostly) > 1:
            mostly.sort(key=lambda x: x[0])
            shared = mostly[0][1] & mostly[1][1]
    for i in shared:
        if not own[i].main or 2 * own[i].linked > len(own[i].text):
            kept[i] = False
    return " ".join(b.text for b, k in zip(own, kept, strict=True) if k)


Key = tuple[str, str, int]


def _keyed(batches: Iterator[pa.RecordBatch], cuts: list[Key]) -> Iterator[list[tuple]]:
    """(part, host, path, page_id, url, fp, packed) of each page, a slice at a time; fp stands for its text."""
    for batch in slices(batches, "html"):
        rows = []
        for page, url, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            host, path = place(url)
            found = json.dumps([[b.text, b.main, b.aside, b.linked] for b in blocks(text or "")], ensure_ascii=False).encode()
            fp = xxhash.xxh3_64_intdigest(found) - (1 << 63)
            rows.append((bisect_right(cuts, (host, path, page or 0)), host, path, page, url, fp, zlib.compress(found, 1)))
        yield rows


EDGE = pa.schema([("part", pa.int32()), ("last", pa.bool_()), ("fp", pa.int64()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string())])


def _edges(cuts: list[Key]):
    """Of the rows of a slice, the first different texts of each part that follow its lower cut in the cut's host, and the last
    ones before its upper cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _keyed(batches, cuts):
            out: list[tuple] = []
            ordered = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] or 0, r[4] or "", r[5]))
            for last, some in ((False, ordered), (True, ordered[::-1])):
                met: dict[int, set[int]] = {}
                for part, host, path, page, url, fp, _ in some:
                    cut = part if last else part - 1
                    if not 0 <= cut < len(cuts) or cuts[cut][0] != host or not host:
                        continue
                    known = met.setdefault(part, set())
                    if fp not in known and len(known) <= REACH:
                        known.add(fp)
                        out.append((part, last, fp, path, page, url))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(EDGE)], schema=EDGE)

    return run


def _beside(edges: list, cuts: list[Key]) -> dict[tuple, list[int]]:
    """(fp, path, page_id, url) of the texts beside each cut -> the parts that they are handed to."""
    first: dict[int, list] = {}
    last: dict[int, list] = {}
    for r in edges:
        (last if r["last"] else first).setdefault(r["part"], []).append(r)
    out: dict[tuple, list[int]] = {}

    def hand(part: int, step: int, table: dict[int, list]) -> None:
        """To part what follows (step 1) or precedes it: from the next part, and from further ones while that holds few texts."""
        host, known, at = cuts[part if step > 0 else part - 1][0], set(), part + step
        while 0 <= at <= len(cuts) and len(known) <= REACH:
            found = table.get(at, [])
            for r in sorted(found, key=lambda r: (r["path"], r["page_id"] or 0, r["url"] or "", r["fp"]), reverse=step < 0):
                if r["fp"] not in known and len(known) <= REACH:
                    known.add(r["fp"])
                    out.setdefault((r["fp"], r["path"], r["page_id"], r["url"]), []).append(part)
            at += step
            edge = at - 1 if step > 0 else at  # the cut between the part just read and the next one
            if not 0 <= edge < len(cuts) or cuts[edge][0] != host:
                break

    for part in range(len(cuts) + 1):
        if part < len(cuts):
            hand(part, 1, first)
        if part:
            hand(part, -1, last)
    return out


DEALT = pa.schema([("part", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("fp", pa.int64()), ("own", pa.bool_()), ("packed", pa.binary())])


def _dealt(cuts: list[Key], beside):
    """The pages of each part, and those beside its cuts (not its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handed = beside.value
        given: set = set()
        for rows in _keyed(batches, cuts):
            out = []
            for part, host, path, page, url, fp, packed in rows:
                out.append((part, host, path, page, url, fp, True, packed))
                key = (fp, path, page, url)
                if key in handed and key not in given:
                    given.add(key)
                    out += [(other, host, path, page, url, fp, False, packed) for other in handed[key]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(DEALT)], schema=DEALT)

    return run


class _Host:
    """The rows of one host in one range, in order; results are made once REACH other texts are known on both sides."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.packed: dict[int, bytes] = {}
        self.before: list[tuple[int, str]] = []  # (fp, path) of the latest different texts, the nearest first
        self.tried = 0

    def add(self, page: tuple, packed: bytes) -> None:
        self.rows.append(page)
        self.packed.setdefault(page[3], packed)

    @staticmethod
    def _push(near: list[tuple[int, str]], fp: int, path: str) -> list[tuple[int, str]]:
        return [(fp, path), *[x for x in near if x[0] != fp]][: REACH + 1]

    def results(self, end: bool) -> list[tuple]:
        """(page_id, url, text, n_chars) of what can be told; at the end of the host, of all."""
        if not end and len(self.rows) < self.tried + TOGETHER:
            return []
        self.tried = len(self.rows)
        stop, after = len(self.rows), []
        if not end:
            seen: set[int] = set()
            while stop and len(seen) <= REACH:
                stop -= 1
                seen.add(self.rows[stop][3])
                after = self._push(after, self.rows[stop][3], self.rows[stop][2])
            if len(seen) <= REACH:
                return []
        following = [()] * stop
        for i in range(stop - 1, -1, -1):
            following[i] = after
            after = self._push(after, self.rows[i][3], self.rows[i][2])
        out, parsed, texts = [], {}, {}

        def of(fp: int) -> list[Block]:
            if fp not in parsed:
                if len(parsed) > 64:
                    parsed.clear()
                parsed[fp] = [Block(*b) for b in json.loads(zlib.decompress(self.packed[fp]))]
            return parsed[fp]

        for (page, url, path, fp, own), later in zip(self.rows[:stop], following, strict=True):
            if own:
                sides = [[x for x in side if x[0] != fp][:REACH] for side in (self.before, later)]
                near = sorted([(d, fp_, path_) for side in sides for d, (fp_, path_) in enumerate(side)], key=lambda x: (-common_beginning(x[2], path), x[0]))
                order = tuple(dict.fromkeys(x[1] for x in near))
                if (fp, order) not in texts:
                    if len(texts) > 64:
                        texts.clear()
                    texts[fp, order] = main_text(of(fp), [of(x) for x in order])
                text = texts[fp, order]
                out.append((page, url, text, len(text)))
            self.before = self._push(self.before, fp, path)
        self.rows = self.rows[stop:]
        known = {r[3] for r in self.rows} | {x[0] for x in self.before}
        self.packed = {fp: x for fp, x in self.packed.items() if fp in known}
        self.tried = len(self.rows)
        return out


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Main texts of rows in order of (part, host, path, page_id, url, fp)."""
    group, host = None, _Host()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RESULT)], schema=RESULT)

    for batch in slices(batches, "packed"):
        for part, name, path, page, url, fp, own, packed in zip(*(batch.column(f.name).to_pylist() for f in DEALT), strict=True):
            if group != (part, name) or not name:  # pages without a host are alone
                yield batch_of(host.results(True))
                group, host = (part, name), _Host()
            host.add((page, url, path, fp, own), packed)
            if found := host.results(False):
                yield batch_of(found)
    yield batch_of(host.results(True))


def extract_main_text(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html, ...).

    Null and empty pages, and pages without main text, give an empty text; whole pages of any length are read.  Pages without a
    host are not paired.  Pages of one path are ordered by page_id (null as 0), url and text; other pages whose paths have
    equally long beginnings in common with a page's come in the order of their distance, those before it first.  Repeated
    rows and null page_ids are kept; extra columns are ignored; an empty table gives an empty result.  ``parts`` sets the
    number of ranges, which changes no result.
    """
    spark = prepare(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    n, size = pages.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    parts = parts or max(parallelism(spark), min(MOST_RANGES, -(-size // RANGE_BYTES)))
    few = pages.select("page_id", "url").where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    sample = sorted((*place(r.url), r.page_id or 0) for r in few.distinct().collect())  # about SAMPLE URLs at most
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    edges = pages.mapInArrow(_edges(cuts), "part int, last boolean, fp long, path string, page_id long, url string")
    place_of = F.struct("path", F.coalesce("page_id", F.lit(0)).alias("k"), F.coalesce("url", F.lit("")).alias("u"), "page_id", "url")
    near = edges.groupBy("part", "last", "fp").agg(F.min(place_of).alias("low"), F.max(place_of).alias("high")).withColumn("at", F.when(F.col("last"), F.col("high")).otherwise(F.col("low")))
    side = Window.partitionBy("part", "last")
    near = near.withColumn("up", F.row_number().over(side.orderBy("at", "fp"))).withColumn("down", F.row_number().over(side.orderBy(F.desc("at"), "fp")))
    found = near.where(F.when(F.col("last"), F.col("down")).otherwise(F.col("up")) <= REACH + 1).select("part", "last", "fp", "at.path", "at.page_id", "at.url")
    rows = [r.asDict() for r in found.collect()] if cuts else []  # at most 2 * (REACH + 1) a range
    beside = spark.sparkContext.broadcast(_beside(rows, cuts))
    dealt = pages.mapInArrow(_dealt(cuts, beside), "part int, host string, path string, page_id long, url string, fp long, own boolean, packed binary")
    in_order = dealt.repartition(parts, "part").sortWithinPartitions("part", "host", "path", F.coalesce("page_id", F.lit(0)), F.coalesce("url", F.lit("")), "fp")
    return in_order.mapInArrow(_paired, "page_id long, url string, text string, n_chars long")
