"""Operator 1: token counts by compiled finite-state transducers.

Two deterministic transducers are compiled from the vocabulary file.

*   The splitter reads classes of characters (with the look-ahead that the pattern needs folded into the
    class) and marks where a pre-token begins.  Its input is cut into chunks; each chunk's map from every state
    to the state after it is computed for all chunks at once, the maps are composed by a parallel prefix
    scan, and the chunks are then read from their true states.
*   The merger reads the bytes of a pre-token; its transitions carry how many tokens the encoding gains.  A state
    is the longest suffix that may still begin a token, with the last token and the relative count at each of its
    positions.  States are made when first reached and kept up to a bound.  It rests on two facts about byte-pair
    encodings: a sequence of tokens is the encoding of its bytes if and only if each two neighbours are the
    encoding of theirs, and so each prefix has exactly one last token that fits the one before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import code_points, every_character, prepare, slices

CHUNK, SPAN = 64, 2_000_000
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, SPACE, WHITE_LAST, WHITE, RESET = range(10)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)


@cache
def character_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACE (only U+0020) or WHITE of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = every_character()
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[code_points(m[0])] = kind
    table[0x20] = SPACE
    return table


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, pre-token begins here) by state * 10 + class."""
    step, begins = np.zeros((8, 10), np.uint8), np.ones((8, 10), bool)
    for state in range(8):
        for kind, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
            step[state, kind] = own
            begins[state, kind] = state not in (own, AFTER_SPACE)
        for kind, rest in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):  # an apostrophe that may begin 's or 're
            run = state in (IN_OTHERS, AFTER_SPACE)
            step[state, kind], begins[state, kind] = (IN_OTHERS, False) if run else (rest, True)
        step[state, SPACE_LAST], step[state, WHITE_LAST] = AFTER_SPACE, START
        for kind in (SPACE, WHITE):
            step[state, kind], begins[state, kind] = IN_WHITE, state != IN_WHITE
        step[state, RESET], begins[state, RESET] = START, False
    step[ONE_MORE, LETTER], begins[ONE_MORE, LETTER] = START, False
    step[TWO_MORE, LETTER], begins[TWO_MORE, LETTER] = ONE_MORE, False
    return step.ravel(), begins.ravel()


def classes_of(points: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Classes with look-ahead: whether white space is the last of its run, whether an apostrophe may begin a contraction."""
    kind = character_classes()[points]
    kind[reset] = RESET
    after = np.append(kind[1:], RESET)
    solid = (after <= OTHER)
    kind[(kind == SPACE) & solid] = SPACE_LAST
    kind[(kind == WHITE) & solid] = WHITE_LAST
    for at in np.flatnonzero(points == 0x27):
        if reset[at]:
            continue
        one = chr(points[at + 1]) if at + 1 < len(points) and not reset[at + 1] else ""
        two = chr(points[at + 2]) if one and at + 2 < len(points) and not reset[at + 2] else ""
        if one and one in "stmd":
            kind[at] = SHORT
        elif one + two in ("re", "ve", "ll"):
            kind[at] = LONG
    return kind


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of state maps (n, states), in log2(n) steps."""
    shift = 1
    while shift < len(maps):
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), 1)
        shift *= 2
    return maps


def boundaries(kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, from classes: chunk maps, their prefix scan, then one pass over all chunks at once."""
    step, begins = splitter()
    n = -(-len(kind) // CHUNK)
    padded = np.full(n * CHUNK, RESET, np.uint8)
    padded[: len(kind)] = kind
    columns = np.ascontiguousarray(padded.reshape(n, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (n, 1))
    for c in columns:
        maps = step[maps * np.uint8(10) + c[:, None]]
    state = np.zeros(n, np.uint8)
    state[1:] = composed(maps)[:-1, START]
    out = np.empty((CHUNK, n), bool)
    for j, c in enumerate(columns):
        at = state * np.uint8(10) + c
        out[j] = begins[at]
        state = step[at]
    return out.T.ravel()[: len(kind)]


class Merger:
    """The transducer of the merges: count(bytes of a pre-token) is the number of its tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: list, most: int = 100_000):
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(plain)]
        back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        raw = lambda s: bytes(map(back.__getitem__, s))
        self.rank = {}
        for i, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = i
        whole = {raw(t) for t in vocabulary if all(c in back for c in t)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank} & whole
        self.openings = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = [(b"", ((b"", 0),))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain merging, for pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), len(self.rank)), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fit(self, a: bytes, b: bytes) -> bool:
        if not a:
            return True
        if (found := self.fits.get((a, b))) is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            found = self.fits[a, b] = self.encode(a + b) == [a, b]
        return found

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        suffix, known = self.states[state]
        grown = suffix + bytes([byte])
        for i in range(len(grown)):
            if (t := grown[i:]) in self.tokens and self.fit(known[i][0], t):
                last, gain = t, known[i][1] + 1
                break
        keep = 0
        while keep < len(grown) and grown[keep:] not in self.openings:
            keep += 1
        info = (*((t, c - gain) for t, c in known), (last, 0))[keep:]
        new = (grown[keep:], info)
        if (n := self.number.get(new)) is None:
            n = self.number[new] = len(self.states)
            self.states.append(new)
        return n, gain

    def count(self, piece: bytes) -> int:
        if len(self.states) > self.most:
            self._clear()
        state = total = 0
        for byte in piece:
            key = state << 8 | byte
            if (move := self.moves.get(key)) is None:
                move = self.moves[key] = self._move(state, byte)
            state = move[0]
            total += move[1]
        return total


class Counts(dict):
    """Token counts of pre-tokens, remembered up to a bound."""

    def __init__(self, merger: Merger):
        super().__init__()
        self.merger = merger

    def __missing__(self, piece: str) -> int:
        n = self.merger.count(piece.encode())
        if len(piece) <= 64:
            if len(self) > 250_000:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts for one vocabulary file of the byte-level kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.counts = Counts(Merger(spec["model"]["vocab"], spec["model"]["merges"]))
        special = [t["content"] for t in spec.get("added_tokens") or []]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def _span(self, segments: list[str]) -> list[int]:
        joined = "\n".join(segments) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        reset = np.zeros(len(points), bool)
        reset[ends] = True
        begins = boundaries(classes_of(points, reset))
        begins[ends] = True
        at = np.flatnonzero(begins)
        upto = np.searchsorted(at, ends).tolist()
        at, out, first = at.tolist(), [], 0
        get = self.counts.__getitem__
        for i in upto:
            out.append(sum(map(get, [joined[a:b] for a, b in zip(at[first:i], at[first + 1 : i + 1], strict=True)])))
            first = i + 1
        return out

    def __call__(self, texts: list[str]) -> list[int]:
        total = [0] * len(texts)
        segments, owner, held = [], [], 0

        def flush() -> None:
            for o, n in zip(owner, self._span(segments), strict=True):
                total[o] += n

        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            total[i] += len(parts) - 1
            for p in parts:
                if p:
                    segments.append(p)
                    owner.append(i)
                    held += len(p)
            if held > SPAN:
                flush()
                segments, owner, held = [], [], 0
        if segments:
            flush()
        return total


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process, kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in slices(batches):
            text = [x or "" for x in batch.column("text").to_pylist()]
            n = np.array(c(text), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x.encode()) for x in text], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text, ...), in one narrow pass.

    Null and empty texts have 0 tokens; texts of any length are counted whole.  Strings of the vocabulary's special tokens inside a text count as one token.
    Repeated rows and null doc_ids are kept; extra columns are ignored; an empty table gives an empty result.
    ``path`` is a byte-level tokenizer file that every executor can read.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
