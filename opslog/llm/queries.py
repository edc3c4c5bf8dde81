"""The registered queries of this subpackage: thin uses of its operators on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslog.llm import (
    bpe, collocations, decontaminate, fitting, language, lm, neardup, neighbours, packing, pages, quality, signatures, substrings,
    toxicity,
)
from opslog.session import stage

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_tokens(table(spark, sf_dir, "documents"))


def digest_tokens(docs: DataFrame, staged: bool = False) -> DataFrame:
    """Encode, decode again, and reduce ids and bytes to digests.

    With ``staged`` the ids are written in between, so that a task has one Python worker at a time instead of two.
    """
    encoded = bpe.encode(docs, RANKS).drop("ends")
    back = bpe.decode(stage(encoded, "ids") if staged else encoded, RANKS)
    return back.select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(parts: int, part: int):
    return F.coalesce(fitting.fold("doc_id", parts) == part, F.lit(False))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    return quality.grade(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), F.col("expected").alias("expected_grade"),
        F.col("tail").alias("tail_probability"))


def op2_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~held_out(5, 0)))
    return language.identify(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score(docs, lm.learn(docs.select("text")))


TOXIC = 0.3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"))


def op6_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, similar=85)


def op8_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, 10, vectors.where("vec_id % 100 = 0"))


def op10_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bit_sliced_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op12_hat_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_ordered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


QUERIES = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_centroid_language": op2_centroid_language,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op5_toxicity": op5_toxicity,
    "op6_recompression": op6_recompression,
    "op7_minhash": op7_minhash,
    "op8_host_suffix_array": op8_host_suffix_array,
    "op9_kmeans_tree": op9_kmeans_tree,
    "op10_cgk_decontamination": op10_cgk_decontamination,
    "op3_byte_bpe": op3_byte_bpe,
    "op11_bit_sliced_bloom": op11_bit_sliced_bloom,
    "op12_hat_trie": op12_hat_trie,
    "op13_ordered_packing": op13_ordered_packing,
}

#: DuckDB twins, where SQL can express the operator; the others are held against brute force in the tests.
SQL: dict[str, str] = {
    "op6_recompression": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM docs)),
later AS (SELECT doc_id, p FROM wins QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM docs),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.p) AS text
  FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, cast(len(ws) AS bigint) AS n_words, cast(len(ws) - coalesce(k.n, 0) AS bigint) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op7_minhash": r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3
  THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 85 * (p.n + q.n - common)),
reached AS (SELECT doc_id, doc_id AS other FROM docs
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT doc_id, cast(coalesce(any_value(n), 0) AS bigint) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op11_bit_sliced_bloom": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
stats AS (SELECT cast(count(*) AS bigint) AS total, cast(sum(len(ts)) AS bigint) AS length FROM docs WHERE len(ts) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark) GROUP BY ALL),
weights AS (SELECT term, cast(floor(1000 * ln((2 * total + 2) / (2 * df + 1))) AS bigint) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
lengths AS (SELECT doc_id, 75 + (25 * len(ts) * total) // length AS m FROM docs, stats WHERE len(ts) > 0),
scores AS (SELECT item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS bigint) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY ALL)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS integer) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20""",
    "op12_hat_trie": r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM docs)),
found AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM pieces
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM pieces),
f AS (SELECT lang, k, phrase, count(*) AS a FROM found GROUP BY ALL),
totals AS (SELECT lang, cast(sum(a) AS bigint) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
longer AS (SELECT lang, part, max(a) AS b FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part
  FROM cand WHERE k = 3) GROUP BY lang, part),
left_out AS (SELECT c.lang, c.phrase FROM cand c JOIN longer o ON o.lang = c.lang AND o.part = c.phrase AND 100 * o.b >= 50 * c.a),
cuts AS (SELECT lang, phrase, a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM cand
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE k = 3),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
  cast((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a) AS bigint) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM scored ANTI JOIN left_out USING (lang, phrase)
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
