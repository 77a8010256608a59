"""The operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, decontaminate, html_text, media, ngram_join, pii, substring_dedup, token_files, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_token_files": token_files.op2_token_files,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_pii": pii.op5_pii,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_html_text": html_text.op8_html_text,
    "op9_media": media.op9_media,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

#: The base-32 alphabet, and upper and lower case.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda k: lpad(bin(instr('0123456789abcdef', substr(digest, k, 1)) - 1), 4, '0')), '') AS b FROM p),
named AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{BASE32}', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(2 ** (4 - j) AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest FROM bits)
SELECT page_id, strlen(payload) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM named"""

LEAK_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(array_slice(w, i, i + least(13, len(w)) - 1), ' ') AS key FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM item),
spot AS (SELECT r, k, i, array_to_string(array_slice(w, i, i + k - 1), ' ') AS key FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT r, item_id, spot.k, i FROM spot JOIN item ON spot.k = item.k AND spot.key = item.key),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

JOIN_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
each AS (SELECT DISTINCT doc_id, array_to_string(array_slice(w, i, i + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM each a JOIN each b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS least_id FROM reach GROUP BY x) USING (doc_id)"""

ORACLES: dict[str, str] = {"op1_warc": WARC_SQL, "op4_decontaminate": LEAK_SQL, "op7_ngram_join": JOIN_SQL}
