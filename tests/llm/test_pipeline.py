"""The corpus pipeline: its stages against each other and on awkward rows."""

from __future__ import annotations

import corpus_pipeline
from tempora.llm.common import cut

from tests.llm.test_operators import LONG, check_packing, linked, sets_of


def test_stages_keep_columns_and_take_effect(spark, data, duck):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n, columns = docs.count(), docs.columns
    sizes = [n]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, data), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * n and sizes[1] >= 0.97 * n
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = duck.execute("SELECT doc_id FROM labels WHERE quality = 0").fetchall()
    assert sum(i in kept for (i,) in labels) < 0.5 * len(labels)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    check_packing(packed, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_stages_on_odd_rows(spark, data):
    english = " ".join(f"the ande {i} of the ind is to anere." for i in range(40))
    kind = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, doc string"
    rows = [(1, english), (2, english), (3, english), (3, english), (None, english), (None, None), (4, None), (5, ""), (6, LONG), (7, english[:200])]
    docs = spark.createDataFrame([(i, t, "en", "s", None, None, None, None) for i, t in rows], kind)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, data)
            got = out.collect()
            assert name == "best_fit_packing" or out.columns == docs.columns
            if given is not docs:
                assert not got
        if name == "ngram_jaccard":
            assert sorted(r.doc_id or 0 for r in stage(spark, docs, data).collect()) == [0, 1, 4, 5, 6, 7]


def test_stages_on_rows_without_or_with_one_id(spark, data, duck):
    """A row goes by its text, whether it has an id of its own or not."""
    item = duck.execute("SELECT text FROM benchmark ORDER BY length(text) DESC").fetchall()[0][0]
    a, b = (" ".join(f"{x}{i * i % 89}" for i in range(80)) for x in "ab")
    kind = "doc_id long, text string, source string"
    docs = spark.createDataFrame([(None, "so " + item, "x"), (1, item, "y"), (5, a, "u"), (5, b, "u"), (6, a + " end", "v"), (None, b, "w"), (5, a, "t"), (None, "", "z"), (None, "", "z"), (9, None, "z")], kind)
    stages = dict(corpus_pipeline.STAGES)
    clean = cut(stages["benchmark_decontamination"](spark, docs, data), "clean")
    assert sorted((r.doc_id or 0, r.source) for r in clean.collect()) == [(0, "w"), (0, "z"), (0, "z"), (5, "t"), (5, "u"), (5, "u"), (6, "v"), (9, "z")]
    single = stages["ngram_jaccard"](spark, clean, data).collect()
    assert sorted((r.doc_id or 0, r.source, r.text) for r in single if r.text) == [(5, "t", a), (5, "u", b)]
    assert sorted((r.doc_id or 0, r.source) for r in single if not r.text) == [(0, "z"), (9, "z")]


def test_single_copies_against_all_pairs(spark, data, duck):
    """The n-gram stage against brute force over the documents of the smallest table."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = [sets_of(t, 5) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    low = linked(pairs, range(len(rows)))
    groups: dict = {}
    for i, root in low.items():
        groups.setdefault(root, []).append(rows[i][0])
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, data).collect()) == sorted(min(g) for g in groups.values())


def test_tables_of_characters_and_samples_leave_the_driver_room():
    import tracemalloc

    import numpy as np

    from tempora.llm import language_id, token_counts, weak_quality

    for table in (token_counts.character_classes, weak_quality.characters):
        tracemalloc.start()
        table.__wrapped__()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6  # 120 MB and more where each character is a string
    some, far = language_id.folded("Größe"), language_id.folded("größe \U00010400")
    assert language_id.narrow(some).nbytes == some.nbytes // 2 and language_id.narrow(far).nbytes == far.nbytes
    assert np.array_equal(language_id.grams(some), language_id.grams(language_id.narrow(some)))
