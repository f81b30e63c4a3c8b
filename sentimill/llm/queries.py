"""One query per operator, each with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentimill.llm.byte_bpe import digests
from sentimill.llm.decontaminate import leaks
from sentimill.llm.fill_middle import fill_middle
from sentimill.llm.html_text import extract
from sentimill.llm.imatch import fingerprints
from sentimill.llm.language_id import language_id
from sentimill.llm.licenses import document_licenses
from sentimill.llm.line_quality import quality
from sentimill.llm.phrases import phrases
from sentimill.llm.simhash import near_duplicates
from sentimill.llm.token_counts import token_counts
from sentimill.llm.toxicity import toxicity
from sentimill.llm.url_filter import url_filter
from sentimill.sources import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licenses(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), restored=True)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: What the URL filter is told; it learns from the URLs that these decide.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "p_block", "verdict")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_text": op2_html_text,
    "op3_token_counts": op3_token_counts,
    "op4_line_quality": op4_line_quality,
    "op5_imatch": op5_imatch,
    "op6_language_id": op6_language_id,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_decontaminate": op10_decontaminate,
    "op11_fill_middle": op11_fill_middle,
    "op12_url_filter": op12_url_filter,
    "op13_phrases": op13_phrases,
}

OP11 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', doc_id::VARCHAR)) AS h FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2,
  CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS x, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS y,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, '<P>' || substr(text, 1, x) AS pre, '<M>' || substr(text, x + 1, y - x) AS mid, '<S>' || substr(text, y + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

OP13 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE f >= 100),
held AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[:k - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c WHERE k > 2) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN held h USING (lang, phrase) WHERE k > 1 AND (h.a IS NULL OR 100 * h.a < 100 * c.a)),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scored AS (SELECT cuts.lang, cuts.phrase, a, j, l.f AS l, r.f AS r, n, 1000::HUGEINT * a::HUGEINT * n::HUGEINT // (l.f::HUGEINT * r.f::HUGEINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = tail JOIN totals t ON t.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {"op11_fill_middle": OP11, "op13_phrases": OP13}
