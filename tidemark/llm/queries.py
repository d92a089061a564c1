"""The queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_repair, decontaminate, divergence, exact_dedup, html_text, jaccard_join, language_id, quality, secrets, substring_dedup, token_counts, warc
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_html_text": op6_html_text,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_warc": op12_warc,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
        SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER g = 1 AS kept, sha256(body) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY body ORDER BY length(t) DESC, doc_id NULLS LAST)
    """,
    "op4_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS content FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
        firsts AS (SELECT content, min(doc_id) AS first FROM windows GROUP BY content HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM windows w JOIN firsts f ON w.content = f.content WHERE first < doc_id),
        words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS word FROM d),
        kept AS (SELECT w.r, count(*) AS n, string_agg(word, ' ' ORDER BY w.k) AS body FROM words w ANTI JOIN gone g ON w.r = g.r AND w.k = g.k GROUP BY w.r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM d LEFT JOIN kept k ON d.r = k.r
    """,
    "op7_decontaminate": r"""
        WITH item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        phrases AS (
            SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS phrase
            FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM item_words WHERE len(ws) > 0)),
        doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        windows AS (
            SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM phrases) WHERE len(ws) >= n)),
        met AS (SELECT doc_id, i, w.n, item_id FROM windows w JOIN phrases p ON w.n = p.n AND w.phrase = p.phrase),
        hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM met) GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id
    """,
    "op10_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        shingles AS (SELECT DISTINCT r, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM d WHERE len(ws) > 0)),
        sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
        common AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
        links AS (SELECT x, y FROM common c JOIN sizes m ON m.r = x JOIN sizes n ON n.r = y WHERE 100 * k >= 90 * (m.n + n.n - k)),
        ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x)
        SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(e.doc_id) AS component_id
        FROM d LEFT JOIN sizes ON d.r = sizes.r JOIN reach ON reach.x = d.r JOIN d e ON reach.y = e.r GROUP BY d.r
    """,
    "op11_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
            FROM documents),
        w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        size AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM d),
        held AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, source, w.term),
        counts AS (
            SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, k.n AS in_lang, s.v, s.total AS lang_total, sum(coalesce(h.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
            FROM groups g JOIN kept k ON g.lang = k.lang JOIN size s ON s.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
        p AS (
            SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (in_lang + 5)) // (lang_total + 5 * v))::BIGINT AS q FROM counts),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
                ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        every AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
    "op12_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        r AS (SELECT page_id, h, sha1(h) AS x, row_number() OVER w AS k, first_value(page_id) OVER w AS keeper FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST))
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
               CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN keeper END AS refers_to
        FROM r
    """,
    "op13_conversation_repair": r"""
        WITH RECURSIVE crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)) ORDER BY n) AS t FROM range(256) r(n)),
        given AS (SELECT coalesce(conv_id::VARCHAR, 'none') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
        hit AS (SELECT g.*, xor(list_reduce([4294967295] || list_transform(range(1, length(id) + 1), lambda j: ascii(id[j])::BIGINT), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS kind FROM given g, crc),
        hurt AS (
            SELECT c, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hit, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS k,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
        rows AS (
            SELECT c, conv_id, turn, role, text, k, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 AS again, right(bare, 1) NOT IN ('.', '!', '?') AS open, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY k) AS before FROM placed),
        told AS (
            SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (open AND NOT blank AND NOT again) AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c),
        walk AS (
            SELECT DISTINCT c, 0::BIGINT AS k, {'c': 0::BIGINT, 'a': '', 't': ''} AS n, {'c': 1000000000000::BIGINT, 'a': '', 't': ''} AS l, {'c': 2::BIGINT, 'a': 'I', 't': 'user:'} AS u, {'c': 4::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS a FROM given
            UNION ALL
            SELECT c, k, n, l, u, list_sort([a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}])[1]
            FROM (
                SELECT c, k, n, l, list_sort([u, {'c': n.c + 2, 'a': n.a || 'I', 't': 'user:'}, {'c': l.c + 2, 'a': l.a || 'I', 't': l.t || chr(10) || 'user:'}, {'c': a.c + 2, 'a': a.a || 'I', 't': a.t || chr(10) || 'user:'}])[1] AS u, a
                FROM (
                    SELECT c, k, {'c': n.c + 3, 'a': n.a || 'D', 't': ''} AS n,
                           list_sort([{'c': l.c + 3, 'a': l.a || 'D', 't': l.t}, {'c': n.c + far + cut + CASE WHEN i = 's' THEN 0 ELSE 1000000000000 END, 'a': n.a || 'K', 't': role || ':' || text}])[1] AS l,
                           list_sort([{'c': u.c + 3, 'a': u.a || 'D', 't': u.t}, {'c': n.c + far + cut + ku, 'a': n.a || eu, 't': ru}, {'c': l.c + far + cut + ku, 'a': l.a || eu, 't': l.t || chr(10) || ru}, {'c': a.c + far + cut + ku, 'a': a.a || eu, 't': a.t || chr(10) || ru}])[1] AS u,
                           list_sort([{'c': a.c + 3, 'a': a.a || 'D', 't': a.t}, {'c': u.c + far + cut + ka, 'a': u.a || ea, 't': u.t || chr(10) || ra}])[1] AS a
                    FROM (
                        SELECT w.c, r.k, n, l, u, a, role, text, i, CASE WHEN blank OR again THEN 1000000000000 ELSE 0 END AS far, open::BIGINT AS cut,
                               CASE WHEN i = 'u' THEN 0 ELSE 2 END AS ku, CASE WHEN i = 'u' THEN 'K' ELSE 'R' END AS eu, CASE WHEN i = 'u' THEN role ELSE 'user' END || ':' || text AS ru,
                               CASE WHEN i = 'a' THEN 0 ELSE 2 END AS ka, CASE WHEN i = 'a' THEN 'K' ELSE 'R' END AS ea, CASE WHEN i = 'a' THEN role ELSE 'assistant' END || ':' || text AS ra
                        FROM walk w JOIN rows r ON r.c = w.c AND r.k = w.k + 1)))),
        done AS (SELECT w.c, list_sort([w.n, w.a])[1] AS best FROM walk w LEFT JOIN told t ON t.c = w.c WHERE w.k = coalesce(t.n, 0))
        SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               best.c AS cost, best.a AS audit, sha256(best.t) AS repaired_sha256
        FROM (SELECT DISTINCT c, conv_id FROM given) g JOIN done d ON d.c = g.c LEFT JOIN told t ON t.c = g.c
    """,
}
