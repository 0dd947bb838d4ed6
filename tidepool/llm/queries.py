"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import codebooks, filters, html, mixing, mpeg, quality, repeats, simhash, tokens, topk, toxicity, warc, wordpiece
from tidepool.llm.columns import taken

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removals(table(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_column(table(spark, sf_dir, "documents"), keep_media=False)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), narrow=True)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokens.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=False)


def op5_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(table(spark, sf_dir, "pages"))


def op6_word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, quality.training_rows(labels))
    scored = quality.score(taken(docs, doc_id="doc_id", text="text"), model)
    return scored.select("doc_id", quality.is_held_out().alias("held_out"), "score", "predicted")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url")


def op13_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.product_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_mpeg_audio,
        op3_mix_sources,
        op4_byte_bpe,
        op5_site_template_removal,
        op6_word_piece_counts,
        op7_simhash_near_dedup,
        op8_quality_classifier,
        op9_exact_top_k,
        op10_toxicity,
        op11_filter_audit,
        op12_warc_bundles,
        op13_product_codes,
    )
}

#: The squared distance of a part from an entry, and the floor of a mean (``//`` cuts towards zero).
_DISTANCE = "CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
_MEAN = "(sum(v[k]) - (sum(v[k]) % count(*) + count(*)) % count(*)) // count(*)"


def _product_code_sql(rounds: int) -> str:
    """Lloyd's rounds one after another, each a pair of table expressions."""
    steps = [
        f"""a{r} AS (
            SELECT p.part, p.vec_id, p.v, arg_min(c.entry, {{'d': {_DISTANCE}, 'e': c.entry}}) AS entry, min({_DISTANCE}) AS d
            FROM parts p JOIN c{r} c USING (part) GROUP BY ALL
        ), c{r + 1} AS (
            SELECT c.part, c.entry, coalesce(s.v, c.v) AS v FROM c{r} c LEFT JOIN (
                SELECT part, entry, list(m ORDER BY k) AS v FROM (
                    SELECT part, entry, k, CAST({_MEAN} AS BIGINT) AS m FROM a{r}, unnest(range(1, len(v) + 1)) AS t(k) GROUP BY ALL
                ) GROUP BY ALL
            ) s USING (part, entry)
        )"""
        for r in range(rounds + 1)
    ]
    return f"""
        WITH whole AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT vec_id, CAST(p AS INTEGER) AS part, v[len(v) * p // 8 + 1 : len(v) * (p + 1) // 8] AS v FROM whole, unnest(range(8)) AS t(p)
        ), c0 AS (
            SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, v FROM parts QUALIFY entry < 16
        ), {", ".join(steps)}, codes AS (
            SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
        ), digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS d FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256
        FROM codes JOIN whole USING (vec_id), digest
    """


ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": r"""
        WITH d AS (
            SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        m AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
            FROM d LEFT JOIN l USING (doc_id)
        ), c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
            WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f
        ), s AS (
            SELECT filter_order, CAST(k AS INTEGER) AS step, filter_order[k] AS f, 1 << (ascii(filter_order[k]) - 65) AS bit,
                   CAST(coalesce(list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(filter_order[j]) - 65))), 0) AS BIGINT) AS before
            FROM o, unnest(range(1, 6)) AS t(k)
        ), r AS (
            SELECT part, filter_order, step, f,
                   CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
                   CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
                   CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
                   CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
                   CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
                   CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
            FROM c, s GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
        FROM r
    """,
    "op12_warc_bundles": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
        t AS (
            SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS digest,
                   CASE WHEN octet_length(encode(h)) >= 1000 AND (page_id < last OR page_id IS NULL) THEN last END AS refers_to
            FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
        FROM t
    """,
    "op13_product_codes": _product_code_sql(codebooks.ROUNDS),
    "op9_exact_top_k": """
        WITH w AS (
            SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), q AS (SELECT DISTINCT ON (vec_id) vec_id, v FROM w WHERE vec_id % 100 = 0),
        s AS (
            SELECT q.vec_id AS query_id, w.vec_id, CAST(list_sum(list_transform(list_zip(q.v, w.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM q JOIN w ON q.vec_id <> w.vec_id AND len(q.v) = len(w.v)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
