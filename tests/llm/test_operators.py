"""The training-data operators against brute force, round trips and held-out accuracy, and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tempora.llm import queries
from tempora.llm.chat_windows import chat_windows, read_back, read_turns
from tempora.llm.language_id import identify_languages, predict, train
from tempora.llm.ngram_jaccard import jaccard_components
from tempora.llm.nn_descent import near_duplicate_vectors, recall
from tempora.llm.packing import Bins, evolve, least_bins, pack_documents, pack_lengths
from tempora.llm.page_differencing import extract_main_text, shared_lines
from tempora.llm.string_tiling import Items, flag_leaks, greedy_tiles, leaked_items, running_tiles
from tempora.llm.token_counts import token_counts
from tempora.llm.warc_derivatives import derivatives, read_records, responses_of, serialized
from tempora.llm.weak_quality import KINDS, LABELLERS, classify_quality, estimate

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} and" for i in range(20_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "Hello world, it's <|endoftext|> fine."), (5, "Hello world, it's <|endoftext|> fine."), (5, "Hello world, it's <|endoftext|> fine."), (None, "no id here"),
    (7, LONG), (8, LONG + " more"), (9, "'s 're'll  x　 y\r\n\n\n  z 12345 été ñandú 日本語 🙂🙂 \x1c a"), (10, "###"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with those made inside."""
    return spark.createDataFrame([(i, t, None, "src", 0, True, 1, 2.0) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n long, kept boolean, id long, score double")


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()


def linked(pairs, ids):
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# 1 ---------------------------------------------------------------------------------------------------------------------
def test_token_counts_of_documents(spark, data, documents):
    t = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, data).collect()}
    for i, text, _ in documents:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 1024)


def test_token_counts_of_odd_rows(spark, odd):
    t = Tokenizer.from_file(BYTES)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(odd, BYTES).collect())
    assert got == sorted((i or 0, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in TEXTS)
    assert token_counts(odd.limit(0), BYTES).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------------
def test_warc_records_are_read_back(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet").limit(20)
    records = derivatives(responses_of(pages))
    rows = records.collect()
    assert len(rows) == 2 * pages.count() and len({r.record_id for r in rows}) == len(rows)
    blob = b"".join(bytes(r.warc) for r in serialized(records).orderBy("page_id", "record_type").collect())
    (tmp_path / "a.warc").write_bytes(blob)
    back = read_records(spark.read.format("binaryFile").load(str(tmp_path / "a.warc"))).collect()
    assert {r.headers["WARC-Record-ID"]: bytes(r.content).decode() for r in back} == {r.record_id: r.content for r in rows}
    for r in rows:
        assert r.content_length == len(r.content.encode()) and f"WARC-Refers-To: {r.refers_to}\r\n" in r.header
    pairs = {r.page_id: {} for r in rows}
    for r in rows:
        pairs[r.page_id][r.record_type] = r
    assert all(p["metadata"].refers_to == p["conversion"].refers_to and p["conversion"].record_id in p["metadata"].content for p in pairs.values())


def test_warc_records_of_compressed_files(spark, data, tmp_path):
    """Files compressed record by record, as crawls are stored, read like plain ones."""
    import gzip

    rows = serialized(derivatives(responses_of(spark.read.parquet(f"{data}/pages.parquet").limit(20)))).orderBy("page_id", "record_type").collect()
    (tmp_path / "a.warc").write_bytes(b"".join(r.warc for r in rows))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.warc)) for r in rows))
    found = read_records(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    plain, packed = ([(tuple(sorted(r.headers.items())), bytes(r.content)) for r in found if r.path.endswith(end)] for end in (".warc", ".gz"))
    assert plain == packed and len(plain) == 40


def test_warc_fields_against_plain_code(spark, data, duck):
    """Every page's two records, their fields taken apart and made again with hashlib only."""
    html = dict(duck.execute("SELECT page_id, coalesce(html, '') FROM pages").fetchall())
    url = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    rows = queries.op2_warc_derivatives(spark, data).collect()
    of = {(r.page_id, r.record_type): r for r in rows}
    assert len(rows) == len(of) == 2 * len(html)
    for (page, kind), r in of.items():
        head = dict(x.split(": ", 1) for x in r.header.strip().split("\r\n")[1:])
        body, payload = r.content.encode(), html[page].encode()
        assert head["WARC-Type"] == kind and head["WARC-Block-Digest"] == sha1(body) == r.block_digest and head["Content-Length"] == str(len(body))
        assert head["WARC-Source-Payload-Digest"] == sha1(payload) and head["WARC-Target-URI"] == head["WARC-Refers-To-Target-URI"] == url[page]
        assert head["WARC-Refers-To"] == of[page, "metadata"].refers_to == of[page, "conversion"].refers_to != head["WARC-Record-ID"]
        if kind == "metadata":
            facts = dict(x.split(": ", 1) for x in r.content.split("\r\n") if x)
            assert facts["source-payload-length"] == str(len(payload)) and facts["http-header-content-type"] == "text/html; charset=utf-8" and facts["charset"] == "utf-8" and facts["http-status"] == "200"
            assert facts["conversion-record-id"] == of[page, "conversion"].record_id and facts["conversion-payload-digest"] == sha1(of[page, "conversion"].content.encode())
            lang = re.search(r'<html lang="(\w+)"', html[page])
            assert facts.get("language") == (lang and lang[1])
        else:
            assert "<p>" not in r.content and "&amp;" not in r.content


def test_warc_of_odd_rows(spark):
    kind = "page_id long, record_id string, target_uri string, date string, http_status int, http_headers string, payload string, content string"
    rows = [(None, None, None, None, None, None, None, "x"), (1, "<urn:a>", "http://h/", "2024", 200, "A: b\r\nC: d", "", "x"), (1, "<urn:a>", "http://h/", "2024", 200, "A: b\r\nC: d", "", "x")]
    got = derivatives(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 6 and all(r.content == "" for r in got if r.record_type == "conversion")
    assert derivatives(spark.createDataFrame([], kind)).count() == 0


def test_warc_language_and_charset_anywhere(spark):
    kind = "page_id long, record_id string, target_uri string, date string, http_status int, http_headers string, payload string"
    far = "<!-- <html lang='xx'> " + "x" * 5000 + " --><html " + " ".join(f"data-n{i}='a>b'" for i in range(60)) + " lang='pt-BR'><script>'<meta charset=bad>'</script><meta name='a' content='b'><meta http-equiv='Content-Type' content='text/html; charset=ISO-8859-1'>"
    rows = [(1, "<urn:a>", "http://h/", "2024", 200, "A: b", far), (2, "<urn:b>", "http://h/", "2024", 200, "Content-Type: text/html; charset=UTF-8", far), (3, "<urn:c>", "http://h/", "2024", 200, None, "<p>lang")]
    got = {r.page_id: r.content for r in derivatives(spark.createDataFrame(rows, kind)).collect() if r.record_type == "metadata"}
    assert "language: pt-BR\r\n" in got[1] and "charset: iso-8859-1\r\n" in got[1]
    assert "language: pt-BR\r\n" in got[2] and "charset: utf-8\r\n" in got[2]
    assert "language" not in got[3] and "charset" not in got[3]


# 3 ---------------------------------------------------------------------------------------------------------------------
def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    m = np.concatenate([base[rng.integers(0, 60, 400)] + rng.standard_normal((400, 16)) * rng.choice([0.05, 0.4, 1.0], (400, 1)), np.tile(base[:1], (50, 1))]).astype(np.float32)
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)] + [(1000 + i, v, 0) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, comp int").repartition(3)
    got = {r.vec_id: r for r in near_duplicate_vectors(frame).collect()}
    x = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    a, b = np.nonzero(s >= 0.9)
    comp = linked(zip(a.tolist(), b.tolist(), strict=True), range(len(m)))
    assert [got[i].n_links for i in range(len(m))] == (s >= 0.9).sum(1).tolist()
    assert [got[i].component_id for i in range(len(m))] == [comp[i] for i in range(len(m))]
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(len(bad)))
    assert near_duplicate_vectors(frame.limit(0)).count() == 0


def test_near_vectors_of_two_saturated_groups(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(32)[:2] * 3 + np.full(32, 1.2)
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    m = np.repeat(centres, 200, 0) + rng.standard_normal((400, 32)) * 0.01
    middle = m.mean(0) * 0.45
    m = np.concatenate([m + middle, rng.standard_normal((400, 32))]).astype(np.float32)
    x = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = x @ x.T
    cross, inner = s[:200, 200:400], s[:200, :200]
    assert (cross >= 0.9).mean() > 0.9 and inner.min() > cross.max()
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")).collect()}
    assert [got[i].n_links for i in range(400)] == ((s >= 0.9).sum(1) - 1)[:400].tolist()
    assert {got[i].component_id for i in range(400)} == {0}


def test_near_vectors_of_lost_pairs(spark):
    assert recall({1: 2000, 2: 2000, 3: 1, 4: 1}, {1: 2000, 2: 2000}, 10) == 0  # a large group does not outweigh pairs
    assert recall({1: 2, 2: 0}, {1: 1}, 10) == 0.5 and recall({}, {}, 10) == 1
    rng = np.random.default_rng(6)
    one = rng.standard_normal((1200, 48))
    side = rng.standard_normal((1200, 48))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side -= (side * one).sum(1, keepdims=True) * one
    m = np.concatenate([one, 0.901 * one + (1 - 0.901**2) ** 0.5 * side / np.linalg.norm(side, axis=1, keepdims=True)])
    m = np.concatenate([m, one[:1] + 0.002 * rng.standard_normal((300, 48))]).astype(np.float32)
    x = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    want = ((x @ x.T >= 0.9).sum(1) - 1).tolist()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(frame, trees=1, rounds=0, attempts=1).collect()}
    assert [got[i] for i in range(len(m))] == want


@pytest.mark.parametrize("how", [{}, {"trees": 1, "rounds": 0, "attempts": 1}])
def test_near_vectors_of_components_over_many_tiles(spark, monkeypatch, how):
    """Large components in several passes, beside small ones, counted exactly both after the graph and after comparing all."""
    from tempora.llm import nn_descent as V

    dealt, real = [], V._dealt
    monkeypatch.setattr(V, "TILE", 40)
    monkeypatch.setattr(V, "PASS_ROWS", 2500)
    monkeypatch.setattr(V, "_dealt", lambda m, p, low=0, high=None: dealt.append(((out := real(m, p, low, high)).count(), low)) or out)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 24))
    m = np.concatenate([base[0] + 0.15 * rng.standard_normal((420, 24)), base[1] + 0.1 * rng.standard_normal((130, 24)), base[rng.integers(2, 40, 150)] + 0.1 * rng.standard_normal((150, 24)), np.tile(base[2], (30, 1))]).astype(np.float32)
    x = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    comp = linked(zip(*[i.tolist() for i in np.nonzero(near)], strict=True), range(len(m)))
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(4), **how).collect()}
    assert [got[i].n_links for i in range(len(m))] == (near.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(m))] == [comp[i] for i in range(len(m))]
    assert max(low for _, low in dealt) > 0 and all(n <= 2500 for n, low in dealt if low)


# 4 ---------------------------------------------------------------------------------------------------------------------
def expected_chat(turns):
    h, loss = hashlib.sha256(), "".join(t or "" for r, t in turns if r == "assistant")
    for r, t in turns:
        h.update(f"{r or ''}\n{t or ''}\n".encode())
    return len(turns), h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_digests_are_read_back(spark, data, duck):
    want: dict = {}
    for c, r, t in duck.execute("SELECT conv_id, role, text FROM conversations ORDER BY conv_id, turn").fetchall():
        want.setdefault(c, []).append((r, t))
    said = r"\### Assistant: </turn> ok"
    want[-7] = [("user", said), ("assistant", said)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op4_chat_windows(spark, data).collect()}
    assert got == {c: expected_chat(t) for c, t in want.items()}


def test_chat_windows_repeat_system_and_history(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * 60) for i in range(1, 40)]
    rows += [(2, 0, None, None), (2, 0, None, None), (None, 3, "a:b\\", "</turn>\\</turn>###\\"), (2, None, "assistant", "x " * 5000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, idx string")
    w = chat_windows(frame, BYTES, budget=512, history=128)
    got = [r for r in w.orderBy("conv_id", "window_id").collect() if r.conv_id == 1]
    assert len(got) > 3 and all(read_turns(r.formatted)[0] == ("system", "be kind") for r in got) and all(r.n_context >= 2 for r in got[1:])
    assert all(r.n_tokens <= 512 for r in got)
    back = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(w).collect()}
    assert back[1] == expected_chat([(r, t) for _, _, r, t in rows[:40]]) and back[None] == expected_chat([("a:b\\", "</turn>\\</turn>###\\")])
    assert back[2] == expected_chat([("assistant", "x " * 5000), (None, None), (None, None)])
    assert chat_windows(frame.limit(0), BYTES).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------------
def test_main_text_without_what_pages_share(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><div>Shop menu home</div><nav>a b</nav>{}<div>Shared footer line</div><div class='comments'><p>I disagree</p></div><script>x<y</script></body></html>"
    rows = [(i, f"https://h.org/a/{i}", page.replace("{}", f"<p>Story &amp; number {i}\n is  here</p><p>More of it {i} and then some</p>"), "x") for i in range(4)]
    rows += [(8, None, None, "x"), (9, "http://[bad", "", "x"), (10, "https://solo.org/", "<article><p>Only</article>", "x"), (10, "https://solo.org/", "<article><p>Only</article>", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in extract_main_text(frame).collect())
    assert [t for _, t, _ in got] == [f"Story & number {i} is here More of it {i} and then some" for i in range(4)] + ["", "", "Only", "Only"] and all(n == len(t) for _, t, n in got)
    assert extract_main_text(frame.limit(0)).count() == 0


def test_main_text_of_short_articles_and_copies(spark):
    page = "<body><div>Home and shop and contact and help and a long menu line</div><div>This site needs your kind attention to this notice</div>{}<div>All rights reserved by the owners of this site</div></body>"
    story = "<p>The {} story</p>"
    rows = [(i, f"https://short.org/a/{i}", page.replace("{}", story.replace("{}", w))) for i, w in enumerate(["first", "second", "third", "fourth"])]
    long = "<p>Copied " + "words of a long article " * 20 + "</p>"
    rows += [(10 + i, f"https://copies.org/b/{i:03}", page.replace("{}", long)) for i in range(20)]
    rows += [(50, "https://copies.org/z", page.replace("{}", "<p>Another " + "text of some length " * 20 + "</p>"))]
    edited = "<p>Article " + "that was edited twice " * 20 + "</p><p>{} edit of a few words</p>"
    rows += [(60 + i, f"https://edits.org/{i}", page.replace("{}", edited.replace("{}", w))) for i, w in enumerate(["One", "Two"])]
    got = {}
    for some in (rows[:4], rows[4:25], rows[25:]):  # few enough for one range each
        got |= {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(some, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"The {w} story" for w in ["first", "second", "third", "fourth"]]
    assert all(got[10 + i].startswith("Copied") and got[10 + i].endswith("article") for i in range(20))
    assert all("that was edited twice" in got[60 + i] for i in range(2))


def longest_common(a, b):
    """The length of a longest common subsequence, by its table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_shared_lines_against_the_table():
    rng = np.random.default_rng(12)
    for _ in range(150):
        a, b = ([f"l{x}" for x in rng.integers(0, int(rng.integers(1, 9)), int(rng.integers(0, 14)))] for _ in range(2))
        found = sorted(shared_lines(a, b))
        left = iter(b)
        assert len(found) == longest_common(a, b) and all(a[i] in left for i in found)  # a subsequence of both


def test_main_text_of_pages_without_telling_tags(spark):
    """Nothing but the alignment tells the article: no article element, no class names.  Any number of ranges gives the same."""
    top, bottom = "<div>Home of things and contact</div><div>Please mind this notice about the site</div>", "<div>Some rights are kept by somebody</div>"
    page = lambda i: f"{top}<div>Story {i} begins with words of its own {i * 7}</div><div>and goes on {i} for a while {i * 3} and ends</div>{bottom}"
    rows = [(i, f"https://plain.org/s/{i:03}", page(i)) for i in range(60)] + [(100 + i, f"https://plain.org/s/020/{i}", page(20)) for i in range(25)] + [(200 + i, "https://one.org/p", page(i)) for i in range(3)]
    rows += [(300, "https://alone.org/x", page(300)), (301, None, page(301)), (None, "https://plain.org/s/030", page(99))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Story {i} begins with words of its own {i * 7} and goes on {i} for a while {i * 3} and ends" for i in range(100)}
    results = []
    for parts in (1, 2, 9, 40, 200):
        got = sorted((r.page_id or 0, r.url or "", r.text) for r in extract_main_text(frame.repartition(3), parts).collect())
        results.append(got)
        assert len(got) == len(rows)
    assert all(r == results[0] for r in results)
    text = {(i, u): t for i, u, t in results[0]}
    assert all(text[i, f"https://plain.org/s/{i:03}"] == want[i] for i in range(60)) and all(text[100 + i, f"https://plain.org/s/020/{i}"] == want[20] for i in range(25))
    assert all(text[200 + i, "https://one.org/p"] == want[i] for i in range(3)) and text[0, "https://plain.org/s/030"] == want[99]
    assert "mind this notice" in text[300, "https://alone.org/x"] and "mind this notice" in text[301, ""]  # nothing to tell them by


def test_main_text_by_ranges_of_real_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    one, many = (sorted((r.page_id, r.url, r.text) for r in extract_main_text(pages, n).collect()) for n in (1, 23))
    assert one == many


# 6 ---------------------------------------------------------------------------------------------------------------------
def sets_of(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_all_pairs(spark, k, percent):
    rng = np.random.default_rng(k)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        w = [str(x) for x in rng.choice(vocabulary, int(rng.integers(3, 120)))]
        for _ in range(int(rng.integers(1, 12))):
            v = list(w)
            for _ in range(int(rng.integers(0, 3))):
                v[int(rng.integers(0, len(v)))] = "changed"
            rows.append((len(rows), " ".join(v)))
    shared = " ".join(vocabulary[:40])
    rows += [(len(rows) + i, f"{shared} tail{i} end") for i in range(40)] + [(5000, None), (5001, ""), (5002, "A b"), (5003, "a B")]
    sets = {i: sets_of(t, k) for i, t in rows}
    ids = [i for i, s in sets.items() if s]
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = linked(pairs, sets)
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame, k, percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_of_odd_rows(spark, odd, duck, data):
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(odd).collect())
    assert got == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (7, 7), (8, 7), (9, 9), (10, 10)]
    assert jaccard_components(odd.limit(0)).count() == 0
    want = sorted(duck.execute(f"SELECT doc_id, n_shingles, component_id FROM ({queries.ORACLE_SQL['op6_ngram_jaccard']})").fetchall())
    assert sorted(tuple(r) for r in queries.op6_ngram_jaccard(spark, data).collect()) == want


def test_jaccard_of_ids_with_several_texts(spark):
    rng = np.random.default_rng(8)
    a, b = ([f"{side}{x}" for x in rng.integers(0, 900, 120)] for side in "ab")
    near = lambda w: " ".join([*w[:60], "changed", *w[61:]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (7, near(b)), (8, " ".join(a + b)), (None, near(a))]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(0, 0), (5, 5), (5, 5), (6, 5), (7, 5), (7, 5), (8, 8)]


# 7 ---------------------------------------------------------------------------------------------------------------------
def test_languages_of_held_out_documents(spark, data, documents):
    lang = {i: x for i, _, x in documents}
    rows = queries.op7_language_id(spark, data).collect()
    assert len(rows) == len(documents) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95 and np.mean([r.accepted for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_rows(spark, odd, data):
    assert {r.lang_pred for r in identify_languages(odd).collect()} == {"und"}  # nothing to learn from
    model = train(spark.read.parquet(f"{data}/documents.parquet"))
    got = {r.doc_id: r for r in predict(odd, model, ("doc_id", "lang", "kept")).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3, 10)) and got[4].lang_pred == "en"
    foreign = spark.createDataFrame([(1, "これは日本語の文章です。"), (2, "Привет, как дела сегодня вечером")], "doc_id long, text string")
    assert not any(r.accepted for r in predict(foreign, model).collect())
    assert predict(odd.limit(0), model).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------------
def check_packing(rows, texts):
    t, bins = Tokenizer.from_file(WORDS), {}
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want: dict = {}
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).extend((p, p * 4096, len(x), zlib.crc32(x.tobytes())) for p in range(-(-len(ids) // 4096)) for x in [ids[p * 4096 : (p + 1) * 4096]])
    assert {i: sorted(p) for i, p in pieces.items()} == {i: sorted(p) for i, p in want.items()}
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in rows)
    return len(bins), -(-total // 4096)


def test_packing_is_whole_and_tight(spark, data, documents):
    used, least = check_packing(queries.op8_best_fit_packing(spark, data).collect(), [(i, t) for i, t, _ in documents])
    assert used <= least + max(1, least // 50)


def test_packing_of_odd_rows(spark, odd):
    check_packing(pack_documents(odd, WORDS).collect(), TEXTS)
    assert pack_documents(odd.limit(0), WORDS).count() == 0


def fewest_bins(lengths, capacity):
    """By trying every way: pieces in order, each into every open bin or a new one."""
    best = len(lengths)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for j in {r: j for j, r in enumerate(room) if r >= lengths[i]}.values():
            put(i + 1, [r - lengths[i] * (k == j) for k, r in enumerate(room)])
        put(i + 1, [*room, capacity - lengths[i]])

    put(0, [])
    return best


def test_bounds_and_evolution_of_bins():
    rng = np.random.default_rng(10)
    for _ in range(40):
        x = sorted(rng.integers(1, 21, int(rng.integers(1, 11))).tolist(), reverse=True)
        least = fewest_bins(x, 20)
        b = Bins(x, 20)
        b.best_fit(list(range(len(x))))
        found = evolve(x, 20, [b.labels()], 1, 30)
        assert least_bins(x, 20) <= least <= len(found.items) <= len(b.items)
        assert sorted(i for g in found.items for i in g) == list(range(len(x))) and max(found.fill) <= 20
    better = 0
    for seed in range(8):
        x = np.random.default_rng(100 + seed).integers(150, 450, 80).tolist()
        b = Bins(x, 1000)
        b.best_fit(list(range(len(x))))
        found = len(evolve(x, 1000, [b.labels()], seed, 150).items)
        assert least_bins(x, 1000) <= found <= len(b.items)
        better += found < len(b.items)
    assert better >= 3


def test_packing_levels_and_islands(spark):
    """Many small blocks: what they leave is dealt again; islands save bins that best fit does not."""
    rng = np.random.default_rng(11)
    x = rng.integers(150, 450, 1600).tolist()
    frame = spark.createDataFrame(list(enumerate(x)), "pid long, length long").repartition(3)

    def bins(**how):
        rows = pack_lengths(frame, 1000, **how).collect()
        at: dict = {}
        for r in rows:
            at.setdefault(r.sequence_id, []).append((r.offset, x[r.pid]))
        assert sorted(r.pid for r in rows) == list(range(len(x)))
        for b in at.values():
            b.sort()
            assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 1000
        return len(at)

    plain, evolved = bins(block=80, epochs=0), bins(block=80, generations=150)
    assert least_bins(x, 1000) <= evolved < plain


# 9 ---------------------------------------------------------------------------------------------------------------------
def test_leaks_reordered_or_not_by_both_ways(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    w = item.split()
    turned = " ".join(w[8:] + ["x"] + w[:8])
    docs = [(1, f"before {item} after"), (2, f"so {turned} it"), (3, " ".join(w[::-1])), (4, "alpha beta gamma delta only"), (5, item.upper().replace(" ", ", ")), (None, item), (6, None), (7, ""), (8, LONG + " " + item)]
    d = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, coverage double")
    b = spark.createDataFrame([(10, item, 0), (11, "too short", 0), (12, None, 0), (None, item, 0), (13, LONG, 0)], "item_id long, text string, hash int")
    got = sorted((r.doc_id, r.item_id, r.matched, r.tiles) for r in leaked_items(d, b).collect())
    assert got == sorted((r.doc_id, r.item_id, r.matched, r.tiles) for r in leaked_items(d, b, broadcast_bytes=0).collect())
    assert [(x, y) for x, y, _, _ in got] == [(1, 10), (2, 10), (5, 10), (8, 10), (8, 13)] and (2, 10, 16, 2) in got
    assert leaked_items(d.limit(0), b).count() == 0 and leaked_items(d, b.limit(0)).count() == 0


def plain_tiles(item, doc, least):
    """Greedy tiling as it is defined: of all free matches the longest, then the first in the item, then in the document."""
    free_item, free_doc, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and free_item[a + n] and free_doc[b + n] and item[a + n] == doc[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < least:
            return out
        free_item[a : a + n] = free_doc[b : b + n] = [False] * n
        out.append(n)


def test_tiles_against_their_definition():
    rng = np.random.default_rng(9)
    for size in (2, 3, 6):
        for _ in range(25):
            item, doc = (rng.integers(1, size + 1, int(rng.integers(4, 40))).astype(np.uint64) for _ in range(2))
            known = Items([(1, " ".join(f"w{x}" for x in item))], 4)
            spelled = np.array([known.vocabulary[f"w{x}"] for x in doc], np.uint64)
            at, low, n = known._met(spelled)
            rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            want = plain_tiles(item.tolist(), doc.tolist(), 4)
            assert greedy_tiles(known.ids[0], spelled, known.place[rows], np.repeat(at, n), 4) == want == running_tiles(item, doc, 4)
            covered = known.tile(spelled, 0.5)
            assert [x[2] for x in covered] == [sum(want)] * (sum(want) >= 0.5 * len(item) and bool(want))


def test_leaks_of_repetitive_and_foreign_texts(spark):
    again = "so it goes " * 7000
    foreign = " ".join(f"слово{i}" for i in range(60))
    b = spark.createDataFrame([(1, "so it goes " * 3000), (2, foreign)], "item_id long, text string")
    d = spark.createDataFrame([(1, again), (2, "x " + foreign.upper()), (None, foreign), (4, "so it goes on")], "doc_id long, text string")
    for most in (1 << 20, 100):
        assert sorted((r.doc_id, r.item_id, r.coverage) for r in leaked_items(d, b, broadcast_bytes=most).collect()) == [(1, 1, 1.0), (2, 2, 1.0)]
        assert sorted((r.doc_id or 0, r.leaked) for r in flag_leaks(d, b, broadcast_bytes=most).collect()) == [(0, True), (1, True), (2, True), (4, False)]


def test_leaks_of_documents(spark, data, documents, duck):
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [(i, plain(t)) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()]
    whole = {(i, j) for i, t, _ in documents for j, p in items if len(p.split()) >= 4 and p in plain(t)}
    got = {(r.doc_id, r.item_id) for r in queries.op9_benchmark_decontamination(spark, data).collect()}
    assert whole <= got and len(got) <= len(whole) + 2


# 10 --------------------------------------------------------------------------------------------------------------------
def test_quality_against_labels(spark, data, documents, duck):
    kept = {r.doc_id: r.kept for r in queries.op10_weak_label_quality(spark, data).collect()}
    labels = duck.execute("SELECT doc_id, quality FROM labels").fetchall()
    assert len(kept) == len(documents)
    assert np.mean([kept[i] for i, q in labels if q == 1]) > 0.97 and np.mean([not kept[i] for i, q in labels if q == 0]) > 0.9


def test_label_model_finds_each_kind_of_flaw():
    """Posteriors of votes drawn from known accuracies, against the exact posterior under those."""
    rng = np.random.default_rng(4)
    kind = np.where(rng.random(4000) < 0.8, 0, rng.integers(1, 1 + len(KINDS), 4000))
    blame = np.full((1 + len(KINDS), len(LABELLERS)), 0.03)
    for k, own in enumerate(KINDS, 1):
        blame[k, list(own)] = 0.9
    votes = np.where(rng.random((4000, len(LABELLERS))) < blame[kind], -1, np.where(rng.random((4000, len(LABELLERS))) < 0.1, 0, 1))
    pattern = ((votes + 1) * 3 ** np.arange(len(LABELLERS))).sum(1)
    share, _, posterior = estimate(Counter(pattern.tolist()))
    exact = np.prod(np.where((votes < 0)[:, None, :], blame, 1 - blame), 2) * np.array([0.8, *[0.2 / len(KINDS)] * len(KINDS)])
    exact = exact[:, 0] / exact.sum(1)
    mine = np.array([posterior[p] for p in pattern.tolist()])
    assert np.mean((mine >= 0.5) == (exact >= 0.5)) > 0.97 and abs(share[0] - 0.8) < 0.05


def test_quality_of_odd_rows(spark, odd):
    rows = classify_quality(odd).collect()
    assert len(rows) == len(TEXTS) and not any(r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert classify_quality(odd.limit(0)).count() == 0


def test_language_scores_against_a_plain_softmax(spark, documents, data):
    """With few languages and with more than the embeddings have numbers, the scores are those of the mean embedding, word by word."""
    from tempora.llm import language_id as L

    rows = [(t, lang) for _, t, lang in documents if t and lang][:120]
    few = L.fit(rows)
    many = L.fit([(f"{t} {'zxcvbnmqwertyu'[i % 14] * 9}", f"{lang}{i % 14}") for i, (t, lang) in enumerate(rows)], epochs=1)
    assert few.softmax is None and few.table.shape[1] == 4 and many.softmax is not None and many.table.shape[1] == L.DIMENSION and len(many.languages) > L.DIMENSION
    for model in (few, many):
        got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(spark.read.parquet(f"{data}/documents.parquet").limit(40), model).collect()}
        for i, text, _ in documents:
            if i in got and text:
                z = np.zeros(len(model.languages))
                ids = L.grams(L.folded(text))
                for g in ids.tolist():
                    z += model.table[g].astype(float) if model.softmax is None else model.table[g].astype(float) @ model.softmax
                e = np.exp(z / len(ids) / model.temperature - (z / len(ids) / model.temperature).max())
                assert got[i][0] == model.languages[int(e.argmax())] and abs(got[i][1] - e.max() / e.sum()) < 1e-6


def test_samples_hold_whole_texts_within_their_bytes(spark, monkeypatch):
    """Long texts are learned from only where a language has no others; what is learned is whole; bytes are bounded."""
    from tempora.llm import language_id as L

    rows = [(i, f"der die das {i} und nicht " * 3, "de") for i in range(60)] + [(100 + i, f"the and of {i} with not " * 40, "en") for i in range(60)] + [(200, "only long words here " * 100, "xx"), (300, "w " * 3000, "de")]
    rows += [(400, "le la les et", "fr"), (400, "le la les et", "es")]  # one document under two languages
    seen = []
    monkeypatch.setattr(L, "fit", lambda r, *a: seen.append(r))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    L.train(df, row_bytes=1000)
    learned = {t for t, _ in seen[0]}
    assert learned <= {t for _, t, _ in rows} and "w " * 3000 not in learned and ("only long words here " * 100 in learned) == (zlib.crc32(b"200") % 4 != 2)
    assert sum(t == "le la les et" for t, _ in seen[0]) <= 1 and ("le la les et", "fr") not in seen[0]
    L.train(df, sample_bytes=4000)
    assert 0 < sum(len(t) for t, lang in seen[1] if lang == "en") < 3000
    L.train(df.repartition(7), row_bytes=1000)
    assert seen[2] == seen[0]


def test_label_model_against_plain_expectation_maximisation(spark, documents):
    """Counting documents by their votes changes nothing: every document on its own gives the same posteriors."""
    import pyarrow as pa

    from tempora.llm.weak_quality import Looks, votes_of

    texts = [t for _, t, _ in documents if t][:150] + ["#$% ^& ## " * 20, "STOP NOW " * 30, "a a a a a a " * 30]
    patterns = Looks(pa.array(texts)).patterns().tolist()
    _, _, got = estimate(Counter(patterns))
    classes = 1 + len(KINDS)
    belief = [[[0.02, 0.13, 0.85]] + [[0.8, 0.13, 0.07] if i in own else [0.1, 0.13, 0.77] for own in KINDS] for i in range(len(LABELLERS))]
    table, share = [[list(c) for c in b] for b in belief], [0.8] + [0.2 / len(KINDS)] * len(KINDS)
    votes = [votes_of(p) for p in patterns]
    for _ in range(60):
        post = []
        for v in votes:
            like = [share[c] * np.prod([table[i][c][v[i] + 1] for i in range(len(v))]) for c in range(classes)]
            post.append([x / sum(like) for x in like])
        mass = [sum(q[c] for q in post) for c in range(classes)]
        for i in range(len(LABELLERS)):
            for c in range(classes):
                seen = [sum(q[c] for q, v in zip(post, votes) if v[i] == vote) + belief[i][c][vote + 1] * (1 + 0.5 * mass[c] + 0.002 * len(votes)) for vote in (-1, 0, 1)]
                table[i][c] = [x / sum(seen) for x in seen]
        share = [(m + 1) / (len(votes) + classes) for m in mass]
    for p, q in zip(patterns, post):
        assert abs(got[p] - q[0]) < 1e-4


def test_scores_against_a_plain_scorer(spark, data):
    """quality_score is the logistic of the weights of a text's features, one by one."""
    import pyarrow as pa

    from tempora.llm import weak_quality as W

    rng = np.random.default_rng(0)
    weights = rng.normal(size=W.WIDTH)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(30)
    run = W._score(spark.sparkContext.broadcast((weights, {})), 0.5, ("doc_id",))
    got = {r.doc_id: (r.quality_score, r.kept, r.posterior) for r in docs.mapInArrow(run, "doc_id long, posterior double, quality_score double, kept boolean").collect()}
    for r in docs.collect():
        ids, x = W.Looks(pa.array([r.text])).features(0)
        s = 1 / (1 + np.exp(-sum(weights[i] * v for i, v in zip(ids.tolist(), x.tolist()))))
        assert abs(got[r.doc_id][0] - s) < 1e-9 and got[r.doc_id][1] == (s >= 0.5) and got[r.doc_id][2] == 0.5


def test_quality_where_all_texts_are_long(spark):
    rows = [(i, f"A fair sentence about topic {i} stands here, as it should. " * 30) for i in range(60)] + [(100 + i, "#### $$$$ @@@@ " * 60) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.kept for r in classify_quality(df).collect()}
    assert {r.doc_id: r.kept for r in classify_quality(df, row_bytes=10).collect()} == whole and not whole[100]


def test_flags_of_repeated_texts_and_a_column_of_that_name(spark):
    """With and without the broadcast: copies are flagged alike, and a window that very many documents share loses nothing."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    other = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    common = " ".join(item.split()[:8])
    rows = [(i, f"{common} and something else number {i} entirely of its own making", True) for i in range(400)] + [(1000 + i, f"so {item} it goes", False) for i in range(40)] + [(None, f"so {item} it goes", None), (2000, other, True), (2001, None, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaked boolean").repartition(4)
    benchmark = spark.createDataFrame([(1, item), (2, other), (3, item)], "item_id long, text string")
    want = sorted((-1 if i is None else i, i is None or i >= 1000 and i != 2001) for i, _, _ in rows)
    for most in (1 << 20, 0):
        got = flag_leaks(docs, benchmark, broadcast_bytes=most)
        assert got.columns == ["doc_id", "text", "leaked"] and sorted((-1 if r.doc_id is None else r.doc_id, r.leaked) for r in got.collect()) == want
