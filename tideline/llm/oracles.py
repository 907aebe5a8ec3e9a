"""SQL for the queries whose results it can express; over large tables it is too slow to be more than a check."""

from __future__ import annotations

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM w, unnest(range(1, len(ws) - 48)) t(i)),
least_doc AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, i FROM win JOIN least_doc USING (s) WHERE d < doc_id), unnest(range(i, i + 50)) t(p)),
one AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS s, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""


def _hash28(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 7) AS BIGINT)"


def _text(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), 'null')"


def mixing(levels: int = 4, seed: int = 1) -> str:
    lots = ""
    for depth in range(levels):
        key = _hash28(f"'{seed}'", f"'{depth}'", _text("source"), _text("block"), _text("pass"))
        lots += f"""
n{depth + 1} AS (SELECT source, block, pass, node * 2 + CAST(row_number() OVER (PARTITION BY node ORDER BY {key}, source NULLS LAST, block, pass) * 2 > count(*) OVER (PARTITION BY node) + node % 2 AS BIGINT) AS node FROM n{depth}),"""
    return f"""
WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, {_hash28(f"'{seed}'", _text('doc_id'), _text('md5(text)'))} AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sized GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS all_words, sum(docs) OVER () AS all_docs, coalesce(sum(source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s1),
s3 AS (SELECT *, CAST(3 * all_words - 4 * capped AS DOUBLE) / CAST(2 * open AS DOUBLE) AS l FROM s2),
s4 AS (SELECT *, max(CASE WHEN l * weight <= 2 * source_size THEN l END) OVER () AS level FROM s3),
s5 AS (SELECT *, least(CAST(2 * source_size AS DOUBLE), coalesce(level * weight, CAST(2 * source_size AS DOUBLE))) AS target FROM s4),
src AS (SELECT source, source_size, target, CAST(ceil(docs / greatest(256, ceil(all_docs / 65536))) AS BIGINT) AS blocks, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS passes,
    CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) % source_size ELSE 0 END AS rest FROM s5),
placed AS (SELECT d.*, source_size, target, passes, rest, (key * blocks) // 268435456 AS block FROM sized d JOIN src s ON d.source IS NOT DISTINCT FROM s.source),
b0 AS (SELECT source, block, CAST(sum(size) AS BIGINT) AS words, any_value(passes) AS passes, any_value(rest) AS rest FROM placed GROUP BY source, block),
b AS (SELECT *, CAST(rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_ FROM b0),
n0 AS (SELECT source, block, pass, 0 AS node FROM b, unnest(range(0, CASE WHEN left_ > 0 AND words > 0 THEN passes + 1 ELSE passes END)) t(pass)),{lots}
sh AS (SELECT source, block, string_agg(CAST(node AS VARCHAR), ',' ORDER BY pass) AS shards FROM n{levels} GROUP BY source, block)
SELECT doc_id, size, source_size, target, p.passes * size + greatest(0, least(size, left_ - coalesce(CAST(sum(size) OVER (PARTITION BY p.source, p.block ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))) AS taken,
    coalesce(shards, '') AS shards
FROM placed p JOIN b ON p.source IS NOT DISTINCT FROM b.source AND p.block = b.block LEFT JOIN sh ON p.source IS NOT DISTINCT FROM sh.source AND p.block = sh.block"""


MIXING = mixing()

EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN low ON vec_id = low.a LEFT JOIN n ON vec_id = n.a"""
