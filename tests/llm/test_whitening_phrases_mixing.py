"""Whitening, phrase mining and source mixing against plain code, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import phrase_mining, whitening
from tempora.llm.phrase_mining import collocations, count_min, phrase_counts
from tempora.llm.source_mixing import mix_sources, source_targets
from tempora.llm.whitening import principal_axes, sums, tiled_covariance, whiten

VECTORS = "vec_id long, embedding array<float>, label int, n long, component string"
DOCS = "doc_id long, text string, lang string, source string, size string, n long, rank int, target boolean"


def plain_whitening(rows, most=8):
    """The contract in numpy and Python integers."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in good]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, total, strict=True)] for v in x])
    covariance = centred.T @ centred / n
    e, axes = np.linalg.eigh(covariance)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True)) for v in x]
    return [i for i, _ in good], n, deviation, centred @ axes / np.sqrt(e), e / np.trace(covariance)


def same_whitening(df, rows):
    ids, n, deviation, white, explained = plain_whitening(rows)
    got = defaultdict(dict)
    for r in df.collect():
        got[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error < 1e-9
    assert sorted(got) == sorted(ids)
    k = white.shape[1]
    have = np.array([[got[i][c + 1].whitened for c in range(k)] for i in ids])
    signs = np.sign((have * white).sum(0))
    assert np.abs(have - white * signs).max() < 1e-6
    assert [int(got[i][1].deviation) for i in ids] == deviation
    assert np.allclose([got[ids[0]][c + 1].explained for c in range(k)], explained, rtol=1e-9)
    return got


@pytest.mark.parametrize("width", [32, 7, 100])
def test_whitening_of_embeddings(spark, data, duck, width):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    same_whitening(whiten(spark.read.parquet(f"{data}/embeddings.parquet"), width=width), rows)


def test_whitening_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3) * [1, 5, 0.2]]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 2.0]), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0])]
    df = lambda some: spark.createDataFrame([(i, v, 1, 5, "x") for i, v in some], VECTORS).repartition(3)
    got = same_whitening(whiten(df(rows + bad), width=2), rows)
    assert all(len(x) == 3 for x in got.values())  # three dimensions, three components
    assert whiten(df(bad[:5])).count() == whiten(df([])).count() == 0
    assert whiten(df(rows[:1])).count() == whiten(df([rows[0]] * 4)).count() == 0  # no spread
    twice = whiten(df(rows + rows[:2] + [(None, [1.0, 2.0, 3.0])]))
    assert twice.count() == 43 * 3 and twice.where("vec_id is null").count() == 3 and twice.where("vec_id = 0").count() == 6
    assert twice.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = whiten(df([(i, [v[0], v[0], 1.0]) for i, v in rows]))  # rank one
    assert {r.component for r in flat.collect()} == {1}
    wide = [(i, [v[0] * 1e9, v[1] * 1e9, v[2]]) for i, v in rows]  # deviations beyond 64 bits
    exact = {r.vec_id: int(r.deviation) for r in whiten(df(wide)).where("component = 1").collect()}
    ids, _, deviation, _, _ = plain_whitening(wide)
    assert [exact[i] for i in ids] == deviation and max(deviation) > 1 << 63


def test_tiles_of_any_width_make_one_covariance(spark):
    x = np.random.default_rng(1).normal(size=(500, 11)) @ np.diag(range(1, 12))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(5)
    n, total = sums(df, "v", 11, False)
    want = np.cov(x.T, bias=True)
    for width in (1, 4, 11, 50):
        assert np.allclose(tiled_covariance(df, "v", 11, n, total, width), want, rtol=1e-10, atol=1e-9)
    e, axes = principal_axes(want, 8)
    assert len(e) == 8 and (np.diff(e) <= 0).all() and np.allclose(axes.T @ axes, np.eye(8))


def plain_phrases(rows, least, top):
    """The contract word by word."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * count[p[i : i + k]]}
        found = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                found.append((score, a, " ".join(p), count[p[:k]], count[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, rank, p, a, left, right, n[lang], score) for rank, (score, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_of_documents(spark, data, duck):
    rows = duck.execute("SELECT text, lang FROM documents").fetchall()
    want = plain_phrases(rows, 5, 50)
    assert rows_of(collocations(spark.read.parquet(f"{data}/documents.parquet"), least=5, top=50)) == want
    assert len({w[0] for w in want}) == 4 and len(want) > 100


@pytest.mark.parametrize("bits, lanes", [(18, 256), (2, 2)])
def test_phrases_of_odd_rows(spark, monkeypatch, bits, lanes):
    """Whatever the sketch lets through, and however its parts are added up."""
    monkeypatch.setattr(phrase_mining, "sketch_bits", lambda docs: bits)
    monkeypatch.setattr(phrase_mining, "TILE", 4 if bits == 2 else 1 << 16)
    monkeypatch.setattr(phrase_mining, "HELD", 7)
    monkeypatch.setattr(phrase_mining, "TOGETHER", 3000)
    monkeypatch.setattr(phrase_mining, "parallelism", lambda spark: lanes)
    texts = [None, "", " \t ", "...", "a b\tc a b c. a  b, c d", "Über Über\x0bstraße İ i", "a b c d e. " * 12, "x " * 70, "tie one tie one, one tie" * 3, ". a b c d", "und so und so und so"]
    rows = [(t, lang) for t in texts for lang in (None, "und", "en")] * 2 + [("a b c d " * 40_000, "en"), ("one" * 100_000 + " b", "fr"), ("only here now " * 4, "fr")]
    df = spark.createDataFrame([(1, t, lang, None, "s", 0, 1, True) for t, lang in rows], DOCS).repartition(4)
    assert rows_of(collocations(df, least=3)) == plain_phrases(rows, 3, 2000)
    assert rows_of(collocations(df, least=400, top=2)) == plain_phrases(rows, 400, 2)  # counters wider than a byte
    assert collocations(df.limit(0)).count() == 0
    assert collocations(df.limit(1)).count() == 0


def test_a_sketch_never_counts_too_low(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(6)
    table = count_min(docs, 30, 4, 18).table
    assert table.max() == 30 and len(table) == 1 << 19
    counts = {(r.lang, r.phrase): r.f for r in phrase_counts(docs).where("words = 1").collect()}
    words = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(F.split(F.lower("text"), r"[ \t.,;:!?\n\x0b\x0c\r]+")).alias("w")).where("w rlike '^[a-z]+$'")
    for r in words.groupBy("lang", "w").count().where("count >= 30").collect():
        assert counts[r.lang, r.w] >= r["count"]


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Share, cut, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())), set(names), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] >= most * sizes[s]}
        for s in full or open_:
            out[s] = Fraction(most * sizes[s]) if full else unit * w[s]
        left -= sum(out[s] for s in full)
        open_ -= full or open_
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_mix(rows, seed=13):
    """taken of each row, by the definition."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    targets, out = plain_targets(sizes), []
    for source, target in targets.items():
        order = []
        for i, t, s in rows:
            if s == source:
                h = hashlib.md5(f"{seed}:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
                share = len(re.sub(r"[\x21-\x40\x5B-\x60\x7B-\x7E]+", "", t)) / len(t) if t else 0.0
                order.append((-math.log((int(h[:13], 16) + 0.5) / 2**52) / max(0.01, share * share), -1 if i is None else i, words(t)))
        rest, epochs = 0, 0
        if sizes[source]:
            epochs, rest = divmod(math.floor(target), sizes[source])
        for _, i, size in sorted(order):
            some = max(0, min(size, rest))
            rest -= some
            out.append((i, size, sizes[source], round(float(target), 6), epochs * size + some))
    return sorted(out)


def mixed(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_mix_of_documents(spark, data, duck):
    rows = duck.execute("SELECT doc_id, text, source FROM documents").fetchall()
    got = mixed(mix_sources(spark.read.parquet(f"{data}/documents.parquet")))
    assert got == plain_mix(rows)
    for name in {s for _, _, s in rows}:
        mine = sum(words(t) for _, t, s in rows if s == name)
        assert mine
    by = defaultdict(int)
    for _, _, source_size, target, taken in got:
        by[source_size, target] += taken
    assert all(abs(taken - target) < 1 for (_, target), taken in by.items())
    assert all(taken <= 3 * size for _, size, _, _, taken in got)


def test_mix_of_odd_rows(spark):
    """Null, empty and hot sources, null and repeated ids, texts without words, and sources that are full."""
    rows = [(1, "a b c", None), (None, "d e", None), (2, None, ""), (2, "", ""), (3, "one two", "é"), (4, "x " * 900, "hot"), (5, " \t\n", "none"), (6, "w. 12 !!", "z")]
    rows += [(i, f"some words {i} here", "hot") for i in range(10, 90)] + [(7, "same row", "copies")] * 40 + [(None, "no id", "copies")] * 20 + [(100 + i, "w " * (i % 5), f"s{i % 9}") for i in range(60)]
    df = lambda some: spark.createDataFrame([(i, t, None, s, "x", 1, 2, True) for i, t, s in some], DOCS).repartition(5)
    got = mix_sources(df(rows))
    assert mixed(got) == plain_mix(rows) == mixed(mix_sources(df(rows[::-1])))
    assert got.columns == ["doc_id", "source", "size", "source_size", "target", "epochs", "taken"]
    assert {r.source for r in got.collect()} == {s for _, _, s in rows}
    assert mix_sources(df([])).count() == 0
    assert [tuple(r)[2:] for r in mix_sources(df([(1, None, "a"), (2, " ", None)])).collect()] == [(0, 0, 0.0, 0, 0)] * 2
    assert [r.taken for r in mix_sources(df([(1, "a b", "a")])).collect()] == [2]


def test_targets_when_many_sources_are_full(spark):
    sizes = {f"s{i:02d}": (1, 10, 100, 5000)[i % 4] for i in range(30)} | {"zero": 0}
    got = source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source_key string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r.source_key: round(r.target, 6) for r in got} == {s: round(float(t), 6) for s, t in want.items()}
    assert abs(sum(r.target for r in got) - sum(sizes.values())) < 1e-6 and all(r.target <= 3 * r.source_size for r in got)


def test_heavy_documents_come_first_more_often(spark):
    """The chance to be first is in proportion to the weight."""
    df = spark.createDataFrame([(i, "w", f"s{i // 2:04d}", float(1 + 3 * (i % 2))) for i in range(4000)], "doc_id long, text string, source string, weight double")
    got = mix_sources(df, F.col("weight"), weights=(1,), most=1, seed=4).collect()
    assert all(r.taken == 1 for r in got)
    first = mix_sources(df.unionByName(df.limit(0)), F.col("weight"), weights=(1, 3)).where("taken > 0").collect()
    light = [r for r in first if r.source_size == 2 and r.target < 2]
    heavy = sum(r.doc_id % 2 for r in light) / len(light)
    assert 0.75 < heavy < 0.85
