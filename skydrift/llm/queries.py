"""The queries of the text operators, with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context_mixing, decontaminate, exact_dedup, license_scan, mixing, near_dedup, quality, sentence_pieces, spelling, suffix_dedup, token_codes, wrapper


# The weights of mixing.Recipe, family by family; a family's level is found as there.
MIXING_SQL = r"""
    WITH m AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
                      ['web', 'books', 'forums', 'reference'][1 + coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT), 0) % 4] AS domain,
                      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
               FROM documents),
         leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY ALL),
         d0 AS (SELECT domain, CAST(sum(tokens) * 4 AS BIGINT) AS cap, CASE domain WHEN 'web' THEN 0.4::DOUBLE WHEN 'books' THEN 0.3::DOUBLE WHEN 'forums' THEN 0.1::DOUBLE WHEN 'reference' THEN 0.2::DOUBLE ELSE 1::DOUBLE END AS w,
                       (SELECT CAST(sum(tokens) AS DOUBLE) FROM leaf) AS budget FROM leaf GROUP BY domain),
         d1 AS (SELECT *, (budget - (sum(cap) OVER (ORDER BY cap / w, domain) - cap)) / sum(w) OVER (ORDER BY cap / w DESC, domain DESC) AS lv FROM d0),
         d2 AS (SELECT domain, least(CAST(cap AS DOUBLE), w * max(lv) OVER ()) AS budget FROM d1),
         l0 AS (SELECT domain, lang, CAST(sum(tokens) * 4 AS BIGINT) AS cap, CASE lang WHEN 'en' THEN 0.5::DOUBLE WHEN 'de' THEN 0.2::DOUBLE WHEN 'fr' THEN 0.2::DOUBLE WHEN 'es' THEN 0.1::DOUBLE ELSE 1::DOUBLE END AS w FROM leaf GROUP BY domain, lang),
         l1 AS (SELECT l0.*, (budget - (sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang) - cap)) / sum(w) OVER (PARTITION BY domain ORDER BY cap / w DESC, lang DESC) AS lv FROM l0 JOIN d2 USING (domain)),
         l2 AS (SELECT domain, lang, least(CAST(cap AS DOUBLE), w * max(lv) OVER (PARTITION BY domain)) AS budget FROM l1),
         s0 AS (SELECT domain, lang, source, tokens, tokens * 4 AS cap, 1::DOUBLE AS w FROM leaf),
         s1 AS (SELECT s0.*, (budget - (sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source) - cap)) / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w DESC, source DESC) AS lv FROM s0 JOIN l2 USING (domain, lang)),
         s2 AS (SELECT domain, lang, source, tokens AS all_tokens, CAST(floor(round(least(CAST(cap AS DOUBLE), w * max(lv) OVER (PARTITION BY domain, lang)), 6)) AS BIGINT) AS budget FROM s1),
         s3 AS (SELECT *, CASE WHEN all_tokens > 0 THEN budget // all_tokens ELSE 0 END AS full_epochs FROM s2),
         k AS (SELECT m.*, full_epochs, budget - full_epochs * all_tokens AS rest,
                      CAST('0x' || substr(md5('17|' || full_epochs || '|' || doc_id), 1, 15) AS BIGINT) AS key
               FROM m JOIN s3 USING (domain, lang, source)),
         t AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id) - tokens AS start FROM k)
    SELECT doc_id, domain, lang, source, tokens AS n_tokens, CAST(full_epochs AS BIGINT) AS full_epochs,
           CAST(greatest(0, least(tokens, rest - start)) AS BIGINT) AS last_tokens,
           CAST(full_epochs * tokens + greatest(0, least(tokens, rest - start)) AS BIGINT) AS taken
    FROM t"""


# A run's crc32 byte by byte from a table made by rule; letters beyond ASCII get a byte each, as the distance counts bytes.
SPELLING_SQL = r"""
    WITH RECURSIVE step AS (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS x FROM range(0, 256) AS r(i)),
         crc AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM step),
         run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
         u AS MATERIALIZED (SELECT w, count(*) AS c, hex(encode(concat(doc_id, ':', w))) AS x FROM run WHERE length(w) >= 6 GROUP BY doc_id, w),
         h AS (SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
                                                        lambda s, b: xor(t[xor(s, b) % 256 + 1], s >> 8))) AS h FROM u, crc),
         cut AS (SELECT CASE WHEN h % 199 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, c FROM h),
         v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n, length(word) AS len,
                      translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', '!"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\]^_`') AS b
               FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
         pair AS MATERIALIZED (SELECT a.word, o.word AS other, o.n AS m FROM v a JOIN v o ON o.len = a.len WHERE a.word <> o.word AND levenshtein(a.b, o.b) = 1
                  UNION ALL SELECT a.word, o.word, o.n FROM v a JOIN v o ON o.len = a.len + 1 WHERE levenshtein(a.b, o.b) = 1
                  UNION ALL SELECT a.word, o.word, o.n FROM v a JOIN v o ON o.len = a.len - 1 WHERE levenshtein(a.b, o.b) = 1),
         best AS (SELECT word, count(*) AS n_near, min({'m': -m, 'other': other}) AS top FROM pair GROUP BY word),
         f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 5 * n THEN top.other END AS form, CASE WHEN -top.m >= 5 * n THEN -top.m END AS form_n FROM v LEFT JOIN best USING (word)),
         chain AS (SELECT word, form AS last FROM f WHERE form IS NOT NULL UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL),
         root AS (SELECT chain.word, chain.last FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NULL)
    SELECT word, form, coalesce(last, word) AS root, n, n_near, form_n FROM f LEFT JOIN root USING (word)"""


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(spark, _read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_codes.encode(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(spark, _read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(spark, _read(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(spark, _read(spark, sf_dir, "pages"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(spark, _read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark, _read(spark, sf_dir, "documents"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentence_pieces.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_decontaminate, op3_license_scan, op4_token_codes, op5_quality, op6_suffix_dedup, op7_exact_dedup, op8_mixing, op9_main_text, op10_context_mixing, op11_spelling, op12_sentence_pieces)}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_mixing": MIXING_SQL,
        "op11_spelling": SPELLING_SQL,
        "op2_decontaminate": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
                 b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
                 bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
                        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
                 dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
                        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                              FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
                 hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
                 hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
                 it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
                   sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)""",
        "op7_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                              regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
                       FROM documents),
                 g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
                              row_number() OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS rn,
                              first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id
                       FROM d)
            SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g""",
    }
