"""The registered queries of the operators, each over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropspark.llm import chunk_bpe, common, decontaminate, divergence, exact, infill, language_model, licenses, packing, pages, quality, secret_scan, shingle_join, toxicity
from cropspark.llm.common import table


def op1_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = common.fold(F.col("doc_id"), 4) == 2
    model = quality.train(docs, labels, ~held_out)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = common.fold(F.col("doc_id"), 5) == 0
    scored = toxicity.score(docs, toxicity.train(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.digest(pages.extract(table(spark, sf_dir, "pages")))


def public_encoder():
    """The encoder of the packing query, made in each task from the installed tokenizer file."""
    import public_tokenizers

    return packing.tokenizer_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_encoder))


def op6_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.group(table(spark, sf_dir, "documents"), width=3, percent=90)


def op7_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact.classify(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("entry.id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("entry") == F.col("keep")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


OP7_SQL = """
WITH t AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
    FROM documents
), g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = common.fold(F.col("doc_id"), 5) == 1
    scorer, counts = language_model.train(docs, ~held_out)
    scored = language_model.score(docs, scorer, counts)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(scorer.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs)))


def op10_license_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of each document, with the number of times each is stated and the sentences that state it."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_matches"), F.sum("sentences").alias("n_sentences"))


def op10_sql() -> str:
    """The notices of one sentence, which are the ones in the tables, as SQL: pieces of lines, normalised, joined with the rules."""
    single = {rule[0]: licence for licence, rule in licenses.RULES if len(rule) == 1}
    values = ", ".join(f"('{form}', '{single[name]}')" for name, forms in licenses.SENTENCES.items() if name in single for form in forms)
    return f"""
WITH known(sentence, license) AS (VALUES {values}),
pieces AS (
    SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?;:])(\\s)', '\\1' || chr(10), 'g'), '\\n')) AS piece FROM documents
), plain AS (
    SELECT doc_id, trim(regexp_replace(regexp_replace(lower(piece), '[^a-z0-9.-]+', ' ', 'g'), '[. -]*$', '')) AS sentence FROM pieces
)
SELECT doc_id, license, count(*) AS n_matches, count(*) AS n_sentences FROM plain JOIN known USING (sentence) GROUP BY ALL
"""


@functools.cache
def public_codec() -> chunk_bpe.Codec:
    """The codec of the encoding query, made in each worker from the installed tokenizer file."""
    import public_tokenizers

    return chunk_bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op11_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.digest(chunk_bpe.decode(chunk_bpe.encode(table(spark, sf_dir, "documents"), public_codec), public_codec))


def op12_sparse_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents")))


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
    SELECT doc_id, body, regexp_extract_all(body, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
        CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM t
), c AS (
    SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM u
), p AS (
    SELECT doc_id, body, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(body) AS restored_sha256
FROM p
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH t AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents
), occ AS (SELECT r, lang, source, unnest(terms) AS term FROM t),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM t),
gn AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM g LEFT JOIN v USING (lang)),
p AS (
    SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (gn.n + 2 * gn.v) AS p
    FROM gn JOIN kept k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term
), q AS (
    SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 2) // (any_value(total) + 2 * any_value(v)) AS q
    FROM c JOIN (SELECT lang, v, sum(n) AS total FROM gn GROUP BY lang, v) USING (lang) GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
        FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
    SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 10
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_cgk_decontamination": (op1_cgk_decontamination, None),
    "op2_compression_quality": (op2_compression_quality, None),
    "op3_noisy_channel_toxicity": (op3_noisy_channel_toxicity, None),
    "op4_page_differencing": (op4_page_differencing, None),
    "op5_differencing_packing": (op5_differencing_packing, None),
    "op6_count_vector_join": (op6_count_vector_join, None),
    "op7_streaming_exact_dedup": (op7_streaming_exact_dedup, OP7_SQL),
    "op8_log_bilinear": (op8_log_bilinear, None),
    "op9_markov_secrets": (op9_markov_secrets, None),
    "op10_license_sentence_rules": (op10_license_sentence_rules, op10_sql()),
    "op11_chunk_reuse_bpe": (op11_chunk_reuse_bpe, None),
    "op12_sparse_infill": (op12_sparse_infill, OP12_SQL),
    "op13_source_divergence": (op13_source_divergence, OP13_SQL),
    "pipeline": (pipeline, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, (build, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
