"""Queries of the operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratepanel.llm import brown, centroids, decontaminate, langid, mixing, quality, setjoin, sharding, simhash, substrings, tokenfiles, topk, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op1_topk_search", TOP_K_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(table(spark, sf_dir, "documents"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passages")


@query("op4_source_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


@query("op5_simhash_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query("op6_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50
), k AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts
), low AS (
  SELECT h, min(doc_id) AS low FROM k GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS pos FROM k JOIN low USING (h) WHERE doc_id > low
), each AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op8_substring_dedup", SUBSTRING_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfiles.read_files(tokenfiles.write_files(table(spark, sf_dir, "documents"), path))


# The cost of every phase of the grammar after every turn, with the letters of its edits; two letters are enough between turns.
TURNS_SQL = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
  FROM conversations
), crc AS (
  SELECT *, list_reduce([4294967295::UBIGINT] || [ord(c)::UBIGINT FOR c IN string_split(place, '')],
    lambda acc, byte: list_reduce([xor(acc, byte), 1, 2, 3, 4, 5, 6, 7, 8],
      lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)) AS c
  FROM said
), fate AS (
  SELECT conv_id, turn, role, text, xor(c, 4294967295::UBIGINT) % 20 AS fate FROM crc
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE fate WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fate WHERE fate <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body
  FROM damaged
), rows AS (
  SELECT *, left(role, 1) AS initial,
    CASE WHEN body = '' THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM numbered
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rows GROUP BY conv_id
), steps AS (
  SELECT conv_id, n, 0::BIGINT AS i, 0 AS phase, 0::BIGINT AS cost, '' AS audit, ''::VARCHAR AS said FROM faults
  UNION ALL
  SELECT conv_id, n, i, phase, (best).cost, (best).audit, (best).said FROM (
    SELECT s.conv_id, s.n, s.i + 1 AS i, m.phase, min({
        'cost': s.cost + 2 * len(f.roles) + m.cost, 'audit': s.audit || repeat('I', len(f.roles)) || m.letter,
        'said': s.said || array_to_string([r || ':' || chr(10) FOR r IN f.roles], '') || m.said}) AS best
    FROM steps s
    JOIN (VALUES (0, 0, []), (0, 2, ['user']), (0, 3, ['user', 'assistant']), (1, 1, []), (1, 2, ['user']),
      (1, 3, ['user', 'assistant']), (2, 2, []), (2, 3, ['assistant']), (2, 2, ['assistant', 'user']), (3, 3, []),
      (3, 2, ['user']), (3, 3, ['user', 'assistant'])) f(phase, after, roles) ON f.phase = s.phase
    LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1
    JOIN LATERAL (
      SELECT f.after AS phase, 3 AS cost, 'D' AS letter, '' AS said WHERE s.i < s.n
      UNION ALL
      SELECT CASE r.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, (r.fault = 't')::INT, 'K', r.role || ':' || r.text || chr(10)
      WHERE s.i < s.n AND r.fault IN ('t', '-') AND (r.initial = CASE f.after WHEN 2 THEN 'a' ELSE 'u' END OR r.initial = 's' AND f.after = 0)
      UNION ALL
      SELECT CASE f.after WHEN 2 THEN 3 ELSE 2 END, 2 + (r.fault = 't')::INT, 'R',
        CASE f.after WHEN 2 THEN 'assistant' ELSE 'user' END || ':' || r.text || chr(10)
      WHERE s.i < s.n AND r.fault IN ('t', '-')
      UNION ALL
      SELECT f.after, 0, '', '' WHERE s.i = s.n AND f.after IN (0, 3)
    ) m ON true
    WHERE s.i <= s.n
    GROUP BY ALL
  )
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce((best).cost, 0) AS cost,
  coalesce((best).audit, '') AS audit, sha256(coalesce((best).said[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (
  SELECT conv_id, min({'cost': cost, 'audit': audit, 'said': said}) AS best FROM steps WHERE i = n + 1 GROUP BY conv_id
) b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op11_turn_repair", TURNS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damage(table(spark, sf_dir, "conversations"))


def cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds written out, every vector with every centroid."""
    parts = [
        r"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h NULLS LAST, q) - 1)::INTEGER AS cluster, q
  FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k})
)""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT i, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q, min(struct_pack(
    d := list_sum([(x[1] - x[2]) ** 2 FOR x IN list_zip(v.q, c{n}.q)])::BIGINT, cluster := cluster)) AS best
  FROM v, c{n} GROUP BY i
)""")
        if n < rounds:
            parts.append(f"""s{n} AS (
  SELECT cluster, j, sum(x)::BIGINT AS s, count(*) AS n
  FROM (SELECT (best).cluster AS cluster, unnest(q) AS x, unnest(range(64)) AS j FROM a{n}) GROUP BY ALL
), m{n} AS (
  SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS q FROM s{n} GROUP BY cluster
), c{n + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN m{n} USING (cluster)
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, (best).d AS distance, sum((best).d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum((best).d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON (best).cluster = cluster"""


@query("op12_centroid_clustering", cluster_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(table(spark, sf_dir, "embeddings"))


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT r, hash(array_to_string(ws[i:i + 4], ' ')) AS h, len(ws) < 5 AS short
  FROM (SELECT r, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT r, count(*) AS n FROM s GROUP BY r
), common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS n FROM s a JOIN s b USING (h, short) WHERE a.r <> b.r GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)
), reached AS (
  SELECT r AS a, r AS b FROM w
  UNION
  SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT any_value(x.doc_id) AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y.doc_id) AS component_id
FROM reached JOIN w x ON x.r = a JOIN w y ON y.r = b LEFT JOIN n ON n.r = a GROUP BY a
"""


@query("op13_jaccard_join", JACCARD_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join_documents(table(spark, sf_dir, "documents"))
