"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
win AS (SELECT k, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
twice AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
rep AS (SELECT k, count(DISTINCT i + o) AS n FROM twice, range(0, 5) r(o) GROUP BY k),
lines AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT k, sum(n - 1) AS n, sum(n) AS lines FROM (SELECT k, line, count(*) AS n FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY k, line) GROUP BY k),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) AS letters,
 length(regexp_replace(t, '[^!?]', '', 'g')) AS bangs, length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, coalesce(lines, 0) AS n_lines
 FROM w LEFT JOIN dup USING (k) LEFT JOIN rep USING (k)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
 + CASE WHEN 100 * up > 60 * letters AND letters >= 20 THEN 8 ELSE 0 END + CASE WHEN 100 * bangs > 60 * n_words THEN 16 ELSE 0 END + CASE WHEN 100 * digits > 40 * greatest(word_chars, 1) THEN 32 ELSE 0 END
 + CASE WHEN 100 * n_dup_lines > 60 * greatest(n_lines, 1) THEN 64 ELSE 0 END + CASE WHEN word_chars > 25 * greatest(n_words, 1) THEN 128 ELSE 0 END + CASE WHEN word_chars < 2 * n_words AND n_words > 0 THEN 256 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 31) = 0 AS kept, fail_bits FROM b
"""

OP4 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top > page_id THEN top END AS refers_to FROM p LEFT JOIN g USING (payload_digest)
"""

OP10 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

ORACLE_SQL = {"op3_quality_rules": OP3, "op4_warc": OP4, "op10_vp_ann": OP10}
