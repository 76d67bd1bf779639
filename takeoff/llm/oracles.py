"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS} AS w FROM documents),
i AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, w, least(len(w), 10) AS l FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, s + 1, s + l), ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - l + 1)) AS s FROM iw)),
dw AS (SELECT row_id, l, s, array_to_string(list_slice(w, s + 1, s + l), ' ') AS win
       FROM (SELECT row_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l)),
hits AS (SELECT row_id, item_id, s, dw.l AS l FROM dw JOIN wins ON dw.win = wins.win AND dw.l = wins.l),
pos AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT row_id, s, l FROM hits)) GROUP BY row_id),
its AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_id, item_id FROM hits) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (row_id) LEFT JOIN its USING (row_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER () AS r FROM pages),
q AS (SELECT page_id, h, sha1(h) AS s, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, r) AS k,
             first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST, r) AS f FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(s, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - i % 8 * 5 AS BIGINT)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to
FROM q
"""

ORACLES: dict[str, str] = {"op4_positional_index_decontamination": CONTAMINATION, "op12_warc_transactions": WARC}
