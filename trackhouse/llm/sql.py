"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from trackhouse.llm import centroids, trie_codes, warc
from trackhouse.llm.exact import SCALE

_WHOLE = f"list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _means(source: str, by: str, number: str, value: str, before: str, keep: str) -> str:
    """Floors of the means of ``value`` by ``by``; what has no rows keeps the value of ``before``."""
    return f"""SELECT {keep}, coalesce(m.value, b.value) AS value FROM {before} b LEFT JOIN (
        SELECT {by}, {number}, CAST(floor(sum({value})::DOUBLE / count(*)) AS BIGINT) AS value FROM {source} GROUP BY ALL) m USING ({keep})"""


def product_codes(parts: int, entries: int, rounds: int) -> str:
    """Codebooks as rows (part, entry, place, value); parts as rows (vec_id, part, place, x)."""
    ctes = [
        f"rows AS (SELECT vec_id, label, {_WHOLE} AS q FROM embeddings WHERE {_FINITE})",
        f"""cells AS (SELECT vec_id, (i - 1) // (len(q) // {parts}) AS part, (i - 1) % (len(q) // {parts}) AS place, q[i] AS x
            FROM rows, unnest(range(1, len(q) + 1)) AS u(i))""",
        f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM rows ORDER BY vec_id LIMIT {entries})",
        "b0 AS (SELECT part, entry, place, x AS value FROM cells JOIN seeds USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS (SELECT vec_id, part, CAST(min(d * {entries} + entry) % {entries} AS BIGINT) AS entry, CAST(min(d * {entries} + entry) // {entries} AS BIGINT) AS d
            FROM (SELECT vec_id, part, entry, CAST(sum((x - value) * (x - value)) AS BIGINT) AS d FROM cells JOIN b{r} USING (part, place) GROUP BY ALL)
            GROUP BY vec_id, part)""")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT part, entry, place, x FROM cells JOIN a{r} USING (vec_id, part))")
            ctes.append(f"b{r + 1} AS ({_means(f's{r}', 'part, entry', 'place', 'x', f'b{r}', 'part, entry, place')})")
    return f"""WITH {', '.join(ctes)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN rows USING (vec_id)"""


def centroid_clusters(width: int, k: int, rounds: int) -> str:
    """Centroids as rows (cluster, place, value); distances over cells."""
    ctes = [
        f"rows AS (SELECT vec_id, {_WHOLE} AS q FROM embeddings WHERE {_FINITE} AND len(embedding) = {width})",
        "cells AS (SELECT vec_id, i AS place, q[i] AS x FROM rows, unnest(range(1, len(q) + 1)) AS u(i))",
        f"seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster FROM rows ORDER BY sha256('2:' || vec_id) LIMIT {k})",
        "b0 AS (SELECT cluster, place, x AS value FROM cells JOIN seeds USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS (SELECT vec_id, CAST(min(d * {k} + cluster) % {k} AS BIGINT) AS cluster, CAST(min(d * {k} + cluster) // {k} AS BIGINT) AS d
            FROM (SELECT vec_id, cluster, CAST(sum((x - value) * (x - value)) AS BIGINT) AS d FROM cells JOIN b{r} USING (place) GROUP BY ALL)
            GROUP BY vec_id)""")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT cluster, place, x FROM cells JOIN a{r} USING (vec_id))")
            ctes.append(f"b{r + 1} AS ({_means(f's{r}', 'cluster', 'place', 'x', f'b{r}', 'cluster, place')})")
    return f"""WITH {', '.join(ctes)},
        names AS (SELECT cluster, sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM b{rounds} GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN names USING (cluster)"""


PRODUCT_CODES = product_codes(trie_codes.PARTS, trie_codes.ENTRIES, trie_codes.ROUNDS)
CENTROIDS = centroid_clusters(centroids.WIDTH, centroids.CENTROIDS, centroids.ROUNDS)

WARC_RECORDS = f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
keyed AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM rows),
firsts AS (SELECT digest, min(page_id) AS first FROM keyed WHERE n >= {warc.LEAST_PAYLOAD} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM keyed LEFT JOIN firsts USING (digest)
"""
