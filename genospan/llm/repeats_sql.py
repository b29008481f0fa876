"""Exact repeats by the definition, as one DuckDB statement: every window of every text, as hexadecimal digits."""

from __future__ import annotations

from .repeats import LENGTH


def repeats_sql(docs: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM {docs}),
w AS (SELECT doc_id, unnest(range(0, n - {LENGTH - 1})) AS i, h FROM d WHERE n >= {LENGTH}),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM k),
a AS (SELECT doc_id, i, CASE WHEN i <= coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {LENGTH}, -1) THEN 0 ELSE 1 END AS new FROM r WHERE nth > 1),
b AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM a),
sp AS (SELECT doc_id, run, min(i) AS lo, max(i) + {LENGTH} AS hi FROM b GROUP BY ALL),
g AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM sp),
c AS (SELECT g.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head, max(hi) AS last, sum(hi - lo) AS gone, count(*) AS runs FROM g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""
