"""Registered queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.chat_windows import chat_windows, read_back
from tempora.llm.common import read
from tempora.llm.language_id import identify_languages
from tempora.llm.ngram_jaccard import jaccard_components
from tempora.llm.nn_descent import near_duplicate_vectors
from tempora.llm.packing import pack_documents
from tempora.llm.page_differencing import extract_main_text
from tempora.llm.phrase_mining import collocations
from tempora.llm.source_mixing import mix_sources
from tempora.llm.string_tiling import leaked_items
from tempora.llm.token_counts import token_counts
from tempora.llm.warc_derivatives import derivatives, responses_of
from tempora.llm.weak_quality import classify_quality
from tempora.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, as byte_bpe_50k.json has them."""
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and the conversion record of every page's response."""
    return derivatives(responses_of(read(spark, sf_dir, "pages")))


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector: cosine 0.9 or more."""
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"), threshold=0.9)


@query
def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from its formatted windows; conversation -7 holds control strings."""
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(chat_windows(turns, public_tokenizers.path("byte_bpe_50k.json")))


@query
def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text."""
    return extract_main_text(read(spark, sf_dir, "pages"))


@query
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: four words, 85 per cent."""
    return jaccard_components(read(spark, sf_dir, "documents"), k=4, percent=85)


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; nothing of the held-out fold is learned from."""
    return identify_languages(read(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece: at most 4096 tokens of word_bpe_49k.json."""
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, coverage of every document that holds half of a benchmark item or more, in any order."""
    return leaked_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, posterior, quality_score, kept of every document."""
    return classify_quality(read(spark, sf_dir, "documents"))


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector: up to eight components."""
    return whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


@query
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first 2000 phrases of two to four words of every language."""
    return collocations(read(spark, sf_dir, "documents"))


@query
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: sources weigh 1, 2, 3 in turn, at most 3 times their words."""
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# Sets of shingles by hashing each list to a number; links by an inverted index; components by spreading minima.
ORACLE_SQL["op6_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
hashed AS MATERIALIZED (SELECT doc_id, n, hash(g) AS g FROM grams),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM hashed a JOIN hashed b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (
  SELECT DISTINCT u AS id, u AS low FROM both_ways
  UNION
  SELECT b.v, r.low FROM reach r JOIN both_ways b ON b.u = r.id AND r.low < b.v
), low AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id FROM sets s LEFT JOIN low l ON l.id = s.doc_id
"""

# All n-grams counted outright; each phrase's cuts by a join on both sides.
ORACLE_SQL["op12_phrase_mining"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists WHERE len(w) > 0),
counts AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase, count(*) AS f FROM starts, (VALUES (1), (2), (3), (4)) AS t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
), totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k AS words, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k >= 2 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, words)) AS cut FROM cand),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut+1:], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, array_to_string(w[i:i+k-1], ' ') AS phrase, max(a) AS a FROM (SELECT *, unnest(range(1, words + 1)) AS i FROM cand WHERE words >= 3), (VALUES (2), (3)) AS t(k)
  WHERE k < words AND i + k - 1 <= words GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 80 * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept k JOIN totals USING (lang) QUALIFY rank <= 2000
"""

# Keys by the same hash; the sources that are full are found by sharing the excess again, round by round.
ORACLE_SQL["op13_source_mixing"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h,
    length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) / nullif(length(text), 0) AS share
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM docs GROUP BY source
), rounds AS (
  SELECT 0 AS step, source, s, w, false AS is_full, CAST((SELECT sum(s) FROM sources) AS BIGINT) AS remaining, CAST((SELECT sum(w) FROM sources) AS BIGINT) AS weights FROM sources
  UNION ALL
  SELECT step + 1, source, s, w, now_full,
    CAST((SELECT sum(s) FROM sources) - sum(CASE WHEN now_full THEN 3 * s ELSE 0 END) OVER () AS BIGINT),
    CAST(sum(CASE WHEN now_full THEN 0 ELSE w END) OVER () AS BIGINT)
  FROM (SELECT *, is_full OR CAST(3 * s AS HUGEINT) * weights <= CAST(remaining AS HUGEINT) * w AS now_full, bool_or(NOT is_full AND CAST(3 * s AS HUGEINT) * weights <= CAST(remaining AS HUGEINT) * w) OVER () AS more FROM rounds)
  WHERE more
), targets AS (
  SELECT source, s, CASE WHEN is_full THEN CAST(3 * s AS DOUBLE) ELSE CAST(remaining * w AS DOUBLE) / weights END AS target,
    CASE WHEN is_full THEN 3 * s ELSE (remaining * w) // weights END AS budget
  FROM rounds WHERE step = (SELECT max(step) FROM rounds)
), placed AS (
  SELECT d.doc_id, d.size, t.s, t.target, t.budget, coalesce(t.budget // nullif(t.s, 0), 0) AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY
      -ln((CAST('0x' || substr(d.h, 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / greatest(0.01::DOUBLE, coalesce(d.share * d.share, 0.0::DOUBLE)), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, s AS source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * s - before)) AS BIGINT) AS taken FROM placed
"""
