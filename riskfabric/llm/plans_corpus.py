"""Queries that repair, mix and cluster: conversations, sources, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.llm import centroids, dialogue, mixing
from riskfabric.llm.common import table


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    found, fixed = dialogue.repair(rows, "present")
    digest = dialogue.digests(fixed).withColumnRenamed("conv_id", "_conv")
    joined = found.join(digest, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", *dialogue.NUMBERS, "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: Every state after every row, without bounds; rows of a conversation are numbered and read one at a time.
OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
marked AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM keyed, crc),
after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM marked WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i, left(role, 1) AS r FROM after),
judged AS (SELECT conv_id, turn, role, text, i, r, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE '' END AS fault,
  CASE WHEN i > 1 AND lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS bad FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
  count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, sum(bad) AS illegal, count(*) AS n FROM judged GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
moves(q, r, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(q, z, audit, cost, body) AS (VALUES (0, 0, '', 0, []), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []),
  (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (2, 3, 'I', 2, ['assistant:']), (3, 2, 'I', 2, ['user:']),
  (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:']), (2, 2, 'II', 4, ['assistant:', 'user:']), (3, 3, 'II', 4, ['user:', 'assistant:'])),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, {'c': CAST(0 AS BIGINT), 'a': '', 'b': CAST([] AS VARCHAR[])} AS best FROM ids
  UNION ALL
  SELECT conv_id, i, q, min(best) AS best FROM (
    SELECT w.conv_id, j.i, e.z AS q, {'c': CAST(w.best.c + n.cost + e.cost AS BIGINT), 'a': w.best.a || n.audit || e.edit, 'b': list_concat(list_concat(w.best.b, n.body), e.body)} AS best
    FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1 JOIN inserts n ON n.q = w.q,
    LATERAL (SELECT n.z AS z, 'D' AS edit, 3 AS cost, CAST([] AS VARCHAR[]) AS body
      UNION ALL SELECT m.z, 'K', CASE WHEN j.fault = 't' THEN 1 ELSE 0 END, [j.role || ':' || j.text] FROM moves m WHERE m.q = n.z AND m.r = j.r AND j.fault NOT IN ('b', 'd')
      UNION ALL SELECT CASE WHEN n.z = 2 THEN 3 ELSE 2 END, 'R', CASE WHEN j.fault = 't' THEN 3 ELSE 2 END, [CASE WHEN n.z = 2 THEN 'assistant:' ELSE 'user:' END || j.text] WHERE j.fault NOT IN ('b', 'd')) e)
  GROUP BY conv_id, i, q),
ended AS (SELECT w.conv_id, min({'c': w.best.c + n.cost, 'a': w.best.a || n.audit, 'b': list_concat(w.best.b, n.body)}) AS best
  FROM walk w LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id JOIN inserts n ON n.q = w.q AND n.z IN (0, 3) WHERE w.i = coalesce(c.n, 0) GROUP BY w.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit,
  sha256(array_to_string(best.b, chr(10))) AS repaired_sha256 FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.concat_ws(",", "centroid"), 256).alias("centroid_sha256"))


def op13_sql(clusters: int = 40, rounds: int = 5) -> str:
    """All distances of all rounds, without a filter."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS place,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT place AS c, x FROM v WHERE place < {clusters})"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT place, vec_id, min([d, c]) AS best FROM (
  SELECT v.place, v.vec_id, c, CAST(list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i} k) GROUP BY ALL)""")
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS x FROM (
  SELECT a.best[2] AS c, j, sum(v.x[j]) AS s, count(*) AS n FROM a{i} a JOIN v USING (place) CROSS JOIN range(1, 65) t(j) GROUP BY ALL) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN m{i} m USING (c))""")
    parts.append(f"""f AS (SELECT vec_id, CAST(best[2] AS INT) AS cluster, CAST(best[1] AS BIGINT) AS distance FROM a{rounds})""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM f JOIN c{rounds} k ON k.c = f.cluster"""


QUERIES = {"op11_conversations": op11_conversations, "op12_mix": op12_mix, "op13_centroids": op13_centroids}
ORACLES = {"op11_conversations": OP11_SQL, "op13_centroids": op13_sql()}
