"""The registered queries of this subpackage: thin wrappers over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import bpe, conversations, decontam, importance, licences, neardup, passages, pii, quality_cnn, simhash, site_style, topk, toxicity_crf
from riskloom.llm.common import read

BPE_RANKS = corpus_pipeline.BPE_RANKS


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.sanitise(read(spark, sf_dir, "documents"))
    counts = [pii.count("base", i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return got.select("doc_id", *counts, F.sha2(pii.printed("base"), 256).alias("base_sha256"), pii.printed("spans").alias("spans"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; their source, language and number make up a tree."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 16).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    got = licences.scan(docs.select(path.alias("path"), "text"))
    return got.withColumn("doc_id", F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = toxicity_crf.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return tagged.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_texts", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repair(conversations.damaged(read(spark, sf_dir, "conversations"))))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.classes(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_decontamination": op3_decontamination,
    "op4_licences": op4_licences,
    "op5_toxicity": op5_toxicity,
    "op6_topk": op6_topk,
    "op7_passages": op7_passages,
    "op8_quality": op8_quality,
    "op9_html": op9_html,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_simhash": op13_simhash,
    "pipeline": corpus_pipeline.run,
}

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

ORACLE: dict[str, str] = {
    "op3_decontamination": f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, len(w) AS m, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM items, unnest(range(1, m - n + 2)) t(s)),
sizes AS (SELECT DISTINCT n FROM wins),
probes AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM docs, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
hits AS (SELECT p.doc_id, p.s, p.n, x.item_id FROM probes p JOIN wins x ON x.n = p.n AND x.win = p.win),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM hits, unnest(range(s, s + n)) t(i) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) d GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)""",
    "op6_topk": """
WITH sound AS (SELECT vec_id, embedding FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM sound),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_conversation_repair": r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hurt AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                                       lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 AS h FROM raw, crc),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
               CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS time FROM hurt),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS i,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, time) AS seen,
               rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM dam),
turns AS (SELECT *, left(role, 1) AS r, CASE WHEN cut = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM num),
moves(q, e, r, z, role) AS (VALUES ('B', 'K', 's', 'S', NULL), ('B', 'K', 'u', 'U', NULL), ('S', 'K', 'u', 'U', NULL), ('U', 'K', 'a', 'A', NULL), ('A', 'K', 'u', 'U', NULL),
  ('B', 'R', NULL, 'U', 'user'), ('S', 'R', NULL, 'U', 'user'), ('U', 'R', NULL, 'A', 'assistant'), ('A', 'R', NULL, 'U', 'user')),
starts AS (SELECT q, '' AS ins, q AS p, 0 AS c, CAST([] AS VARCHAR[]) AS lines FROM (VALUES ('B'), ('S'), ('U'), ('A')) v(q)
           UNION ALL SELECT q, 'I', z, 5, [role || ':'] FROM moves WHERE e = 'R'),
options AS (SELECT s.q, s.ins || 'D' AS edit, s.c + 2 AS c, s.p AS z, s.lines, CAST(NULL AS VARCHAR) AS r, CAST(NULL AS VARCHAR) AS role, FALSE AS stays FROM starts s
            UNION ALL SELECT s.q, s.ins || m.e, s.c + CASE m.e WHEN 'R' THEN 1 ELSE 0 END, m.z, s.lines, m.r, m.role, TRUE FROM starts s JOIN moves m ON m.q = s.p),
best AS (SELECT conv_id, 0 AS i, 'B' AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM (SELECT DISTINCT conv_id FROM conversations) c
  UNION ALL
  SELECT conv_id, i, z, w.cost, w.audit, w.lines FROM (
    SELECT b.conv_id, t.i, o.z, min({'cost': b.cost + o.c + CASE WHEN o.stays AND t.fault = 't' THEN 5 ELSE 0 END, 'audit': b.audit || o.edit,
           'lines': b.lines || o.lines || CASE WHEN o.stays THEN [coalesce(o.role, t.role) || ':' || t.text] ELSE [] END}) AS w
    FROM best b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i + 1
    JOIN options o ON o.q = b.q AND (NOT o.stays OR (t.fault IN ('', 't') AND (o.r IS NULL OR o.r = t.r)))
    GROUP BY b.conv_id, t.i, o.z) s),
facts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                 count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
ended AS (SELECT b.conv_id, min({'cost': b.cost + CASE b.q WHEN 'U' THEN 5 WHEN 'S' THEN 10 ELSE 0 END, 'audit': b.audit || CASE b.q WHEN 'U' THEN 'I' WHEN 'S' THEN 'II' ELSE '' END,
                 'lines': b.lines || CASE b.q WHEN 'U' THEN ['assistant:'] WHEN 'S' THEN ['user:', 'assistant:'] ELSE [] END}) AS w
          FROM best b LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id WHERE b.i = coalesce(f.n, 0) GROUP BY b.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(e.w.cost AS BIGINT) AS cost,
       e.w.audit AS audit, sha256(array_to_string(e.w.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op12_importance_resampling": f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
words AS (SELECT doc_id, row_number() OVER () AS row, TRUE AS corpus, {_WORDS} AS w FROM documents
          UNION ALL SELECT item_id, -row_number() OVER (), FALSE, {_WORDS} FROM benchmark),
runs AS (SELECT row, corpus, array_to_string(w[s:s + k - 1], ' ') AS f FROM words, (VALUES (1), (2), (3)) v(k), unnest(range(1, len(w) - k + 2)) r(s)),
counted AS (SELECT row, corpus, f, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT f, list_transform(range(CAST(strlen(f) AS BIGINT)), lambda i: CAST('0x' || hex(encode(f))[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM (SELECT DISTINCT f FROM counted) d),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM bytes, crc),
cells AS (SELECT row, corpus, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
hist AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (corpus), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT corpus), 0) AS DOUBLE) AS t FROM cells GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM hist),
sums AS (SELECT row, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM cells JOIN gain USING (bucket) WHERE corpus GROUP BY row),
draws AS (SELECT d.doc_id, len(d.w) >= 20 AS long_enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
          FROM words d LEFT JOIN sums USING (row) WHERE d.corpus),
ranked AS (SELECT *, CASE WHEN long_enough THEN row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM draws)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM draws WHERE long_enough) * 5 // 100 THEN place END AS rank FROM ranked""",
}
