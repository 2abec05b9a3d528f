"""The queries of this subpackage for ``__spark_entry__.py``, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, codes, exact, fim, mixing, neardup, packing, pii, quality, secrets, toxicity, warc
from .common import small_batches, table


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS u
  FROM documents),
s AS (
  SELECT source, source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
fill(step, level) AS (
  SELECT 0, CAST(0 AS DOUBLE)
  UNION ALL
  SELECT step + 1, risen FROM (
    SELECT f.step, f.level, (SELECT CAST(max(total) - coalesce(sum(CASE WHEN 3 * source_size <= weight * f.level THEN 3 * source_size END), 0) AS DOUBLE)
        / CAST(sum(CASE WHEN 3 * source_size <= weight * f.level THEN NULL ELSE weight END) AS DOUBLE) FROM s) AS risen
    FROM fill f) WHERE risen > level),
t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * (SELECT max(level) FROM fill)) AS target FROM s),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, size - greatest(0, upto - extra)) AS BIGINT) AS taken
FROM (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size AS extra,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
"""


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, row_number() OVER (PARTITION BY hex ORDER BY page_id NULLS LAST, url) AS k,
             first_value(page_id) OVER (PARTITION BY hex ORDER BY page_id NULLS LAST, url) AS lead FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda j: list_aggregate(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * j + 1 AS INT), 5) AS INT) >> b) & 31) AS INT), 1)),
    'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN lead END AS refers_to
FROM g
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.find(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").withColumn("path", F.col("source"))
    lang = secrets.language(docs)
    return secrets.scan(docs, secrets.train(spark.createDataFrame(secrets.labelled()), lang), lang)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    probe = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.digests(chat.formatted(rows))


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS shown,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS who FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length(who) + length(shown) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.link(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(len(ws) - 2), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON m.a = d.doc_id
"""

def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fim.digests(fim.transform(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (
  SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(hex, CAST(k AS INT), 8) AS BIGINT)) AS h FROM d),
f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
              WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS prefix, coalesce(array_to_string(u[low + 1:high], ''), '') AS middle,
         coalesce(array_to_string(u[high + 1:n], ''), '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.with_label_error(codes.compress(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op12_sql() -> str:
    """Two rounds and the last assignment, each a pair of common table expressions."""
    steps = []
    for k in range(3):
        steps.append(f"""
far{k} AS (
  SELECT v.rid, v.p, c.e, CAST(list_sum(list_transform(range(len(v.x)), lambda j: (v.x[j + 1] - c.x[j + 1]) * (v.x[j + 1] - c.x[j + 1]))) AS BIGINT) AS far
  FROM v JOIN c{k} c ON c.p = v.p),
near{k} AS MATERIALIZED (
  SELECT rid, p, min(far) AS far, arg_min(e, far * 1000 + e) AS e FROM far{k} GROUP BY rid, p)""")
        if k < 2:
            steps.append(f"""
mean{k} AS (
  SELECT p, e, list(m ORDER BY j) AS x FROM (
    SELECT p, e, j, CAST(sum(y) // count(*) - CASE WHEN sum(y) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS m
    FROM (SELECT n.p, n.e, unnest(range(len(v.x))) AS j, unnest(v.x) AS y FROM near{k} n JOIN v ON v.rid = n.rid AND v.p = n.p) GROUP BY p, e, j)
  GROUP BY p, e),
c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN mean{k} m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH i AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS whole
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT rid, p, whole[CAST(1 + p * (len(whole) // 16) AS BIGINT):CAST((p + 1) * (len(whole) // 16) AS BIGINT)] AS x FROM i, (SELECT unnest(range(16)) AS p)),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM v WHERE rid <= 64),{",".join(steps)},
r AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM near2 GROUP BY rid)
SELECT i.vec_id, r.code, r.error, CAST(sum(r.error) OVER (PARTITION BY i.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM i JOIN r ON r.rid = i.rid
"""


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) AS k FROM d)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_warc": op1_warc, "op2_secrets": op2_secrets, "op3_toxicity": op3_toxicity, "op4_mixing": op4_mixing, "op5_ann": op5_ann,
        "op6_chat": op6_chat, "op7_packing": op7_packing, "op8_neardup": op8_neardup, "op9_pii": op9_pii, "op10_quality": op10_quality,
        "op11_fim": op11_fim, "op12_codes": op12_codes, "op13_exact": op13_exact, "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL, "op4_mixing": OP4_SQL, "op6_chat": OP6_SQL, "op8_neardup": OP8_SQL,
        "op11_fim": OP11_SQL, "op12_codes": _op12_sql(), "op13_exact": OP13_SQL,
    }
