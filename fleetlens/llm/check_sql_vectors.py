"""SQL of the queries over vectors, written plainly: all distances, all pairs."""

from __future__ import annotations


def centroid_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, k, d FROM (
  SELECT r, k, d, row_number() OVER (PARTITION BY r ORDER BY d, k) AS n FROM (
    SELECT r, k, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{i})) WHERE n = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM (
  SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS p FROM a{i} JOIN kept USING (r)) GROUP BY k, p) GROUP BY k),
c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.k = m{i}.k)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT k, v FROM (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v FROM kept) WHERE k < {k}),{",".join(steps)}
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r) JOIN c{rounds} c ON c.k = a.k"""


def near_sql(least: float = 0.9) -> str:
    return f"""
WITH RECURSIVE x AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
met AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {least}),
link AS MATERIALIZED (SELECT a, b FROM met UNION ALL SELECT b, a FROM met),
reach AS (SELECT a AS id, a AS low FROM link UNION SELECT l.b, r.low FROM reach r JOIN link l ON l.a = r.id WHERE r.low < l.b),
low AS (SELECT id, min(low) AS low FROM reach GROUP BY id),
n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low.low, vec_id) AS component_id, coalesce(low.low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN low ON low.id = vec_id"""
