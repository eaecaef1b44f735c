"""SQL that gives the rows of the queries which SQL can express."""

from __future__ import annotations

from tallyweave.llm.mixing import MOST, SHARE, WEIGHTS
from tallyweave.llm.sharding import SHARDED_SQL

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALPHANUMERIC = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY payload) END AS first FROM p)
SELECT page_id, url, CAST(n AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
    CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

CONTAMINATED_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({LOWERED}, {ALPHANUMERIC}) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({LOWERED}, {ALPHANUMERIC}) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) x(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT * FROM dw, (SELECT DISTINCT n FROM win)), unnest(range(1, len(w) - n + 2)) x(i)),
hit AS (SELECT doc_id, i, n, item_id FROM pos JOIN win USING (n, t)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(0, n)) x(j) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

REPEATED_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM dw, unnest(range(1, len(w) - 33)) x(i)),
again AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM again, unnest(range(0, 35)) x(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM dw),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
"""

MIXED_SQL = f"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {SPACED})) AS BIGINT) AS size,
        -ln((CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE)) / CASE WHEN q = 1 THEN 2 ELSE 1 END AS k
    FROM documents LEFT JOIN best USING (doc_id)
),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST({list(WEIGHTS)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS w, CAST({MOST} AS DOUBLE) * source_size AS cap FROM s),
r AS (
    SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS nth,
        (CAST({SHARE} AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
    FROM w
),
level AS (SELECT min(nth) AS at, arg_min(rate, nth) AS rate FROM r WHERE rate <= cap / w),
t AS (SELECT source, source_size, CASE WHEN nth >= level.at THEN w * level.rate ELSE cap END AS target FROM r, level),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END AS epochs FROM t),
m AS (
    SELECT d.*, source_size, target, epochs, least(size, greatest(0, CASE WHEN source_size > 0 THEN floor(target + 0.5) - epochs * source_size ELSE 0 END
        - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS given
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + given AS BIGINT) AS taken,
    CAST(epochs + CASE WHEN given > 0 AND given * 2 >= size THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM m
"""

TAKES_PART = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

NEIGHBOURS_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings WHERE {TAKES_PART}),
s AS (
    SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.c, d.c) AS BIGINT) AS score
    FROM v q JOIN v d ON q.r <> d.r WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def _assigned(codebooks: str) -> str:
    """The nearest entry of each part: its index and squared distance, packed so that the least one has the lower index."""
    return f"""
        SELECT p.r, p.part, min(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))) * 64 + b.entry) AS m
        FROM p JOIN {codebooks} b ON p.part = b.part GROUP BY p.r, p.part"""


def _moved(codebooks: str, assigned: str) -> str:
    """Entries replaced by the floors of their parts' means; those without parts stay."""
    return f"""
        SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM {codebooks} b LEFT JOIN (
            SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS v FROM (
                SELECT p.part, CAST(m % 64 AS BIGINT) AS entry, place, sum(p.v[place]) AS total, count(*) AS n
                FROM p JOIN {assigned} a ON p.r = a.r AND p.part = a.part, unnest(range(1, len(p.v) + 1)) x(place) GROUP BY ALL
            ) GROUP BY part, entry
        ) n ON b.part = n.part AND b.entry = n.entry"""


GRID_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE {TAKES_PART}),
w AS (SELECT (max(len(embedding)) + 15) // 16 AS w FROM e),
p AS MATERIALIZED (
    SELECT r, part, list_transform(range(1, w + 1), lambda i: coalesce(CAST(floor(256 * CAST(embedding[part * w + i] AS DOUBLE)) AS BIGINT), 0)) AS v
    FROM e, w, unnest(range(0, 16)) x(part)
),
b0 AS MATERIALIZED (SELECT part, CAST(r - 1 AS BIGINT) AS entry, v FROM p WHERE r <= 64),
a0 AS MATERIALIZED ({_assigned("b0")}),
b1 AS MATERIALIZED ({_moved("b0", "a0")}),
a1 AS MATERIALIZED ({_assigned("b1")}),
b2 AS MATERIALIZED ({_moved("b1", "a1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
books AS (SELECT sha256(string_agg(CAST(v[place] AS VARCHAR), ',' ORDER BY part, entry, place)) AS h FROM b2, unnest(range(1, len(v) + 1)) x(place)),
coded AS (SELECT r, string_agg(printf('%02x', CAST(m % 64 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM e JOIN coded USING (r), books
"""

ORACLES = {
    "op1_warc_transactions": WARC_SQL,
    "op4_suffix_decontamination": CONTAMINATED_SQL,
    "op7_repeated_passages": REPEATED_SQL,
    "op8_extendible_shards": SHARDED_SQL,
    "op9_mixed_sources": MIXED_SQL,
    "op11_voronoi_neighbours": NEIGHBOURS_SQL,
    "op12_grid_codes": GRID_SQL,
}
