"""One query per operator, each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_warc, compaction, decontaminate, host_rules, lm, near_dup, packing, sanitise, secret_scan, toxicity
from .common import Scratch, fold_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), train=fold_of("doc_id") != 0)
    scored = toxicity.score(docs, lexicon, keep=["doc_id"])
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = arc_warc.archive(table(spark, sf_dir, "pages"))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"), n=3, pct=85).drop("n_links")


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected", "host_watched")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = compaction.ShardStore(spark, Scratch(spark, "shards").path)
    store.append(table(spark, sf_dir, "documents"))
    store.compact()
    store.vacuum()
    return store.located().select("doc_id", "n_chars", "shard", "shard_bytes", "manifest_version")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered", "n_tiles", "coverage")


def op7_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = sanitise.detect(table(spark, sf_dir, "documents"))
    counts = [sanitise.count("base", k).alias(f"n_{sanitise.KINDS[k]}") for k in range(4)]
    return spans.select("doc_id", *counts, F.sha2(sanitise.named("base"), 256).alias("base_sha256"), sanitise.named("all_spans").alias("spans"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = secret_scan.scan(docs, secret_scan.train(docs), keep=["doc_id"])
    counts = [secret_scan.count("base", k).alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)]
    return spans.select("doc_id", *counts, F.sha2(secret_scan.named("base"), 256).alias("base_sha256"), secret_scan.named("spans").alias("spans"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), train=fold_of("doc_id") != 1)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


_ALL = (op1_toxicity, op2_warc, op3_near_duplicates, op4_host_rules, op5_sharding, op6_decontamination, op7_sanitisation, op8_best_fit_packing, op9_secret_scan, op10_lm_scoring)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)
    """,
    "op3_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.doc_id = d.doc_id
    """,
    "op4_host_rules": r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, a || ' ' || lead(a, 1) OVER o || ' ' || lead(a, 2) OVER o AS g FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(*) AS k FROM (SELECT DISTINCT doc_id, i + d AS i FROM again, (SELECT unnest([0, 1, 2]) AS d)) GROUP BY doc_id),
ln AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS k FROM ln GROUP BY doc_id),
f AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda z: length(z))), 0)::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(dup.k, 0) AS n_dup_lines, coalesce(rep.k, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
u AS (SELECT doc_id, source AS host, unnest(['base', 'symbols', 'dup_lines', 'repeats', 'word_length']) AS rule,
        unnest([base_failed, 10 * n_symbols > 3 * n_words, 10 * n_dup_lines > 2 * n_lines, 10 * n_repeat_words > 2 * n_words, word_chars < 2 * n_words OR word_chars > 20 * n_words])::INT AS failed FROM b WHERE source IS NOT NULL),
h AS (SELECT host, rule, count(*) AS n, sum(failed) AS k FROM u GROUP BY ALL),
m AS (SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(k) / sum(n) AS mean, sum(k * k / n) AS sq, sum(1 / n) AS inv FROM h GROUP BY rule),
v AS (SELECT *, hosts * (sq - docs * mean * mean) / ((hosts - 1) * docs) AS var FROM m),
s AS (SELECT rule, mean, CASE WHEN hosts < 2 THEN 2.0 WHEN var - mean * (1 - mean) / hosts * inv <= 0 THEN 1e6
        ELSE least(1e6, greatest(1.0, (mean * (1 - mean) - var) / (var - mean * (1 - mean) / hosts * inv))) END AS strength FROM v),
rate AS (SELECT host, rule, n, mean, strength, (k + mean * strength) / (n + strength) AS r FROM h JOIN s USING (rule)),
sd AS (SELECT host, rule, mean, r, sqrt(r * (1 - r) / (n + strength + 1)) AS d FROM rate),
bad AS (SELECT host, bool_or(r - d > 0.5) AS rejected FROM sd GROUP BY host),
watch AS (SELECT DISTINCT doc_id FROM u JOIN sd USING (host, rule) WHERE failed = 1 AND r - 1.645::DOUBLE * d > mean)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(rejected, false) AS host_rejected, watch.doc_id IS NOT NULL AS host_watched,
  NOT base_failed AND NOT coalesce(rejected, false) AND watch.doc_id IS NULL AS kept
FROM b LEFT JOIN bad ON host = source LEFT JOIN watch USING (doc_id)
    """,
    "op10_lm_scoring": r"""
WITH tab AS (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, v)) AS t),
ids AS (SELECT doc_id, text, xor(4294967295, list_reduce(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ord(ch)::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) % 5 AS fold FROM documents, tab),
w AS (SELECT doc_id, fold <> 1 AS trained, list_concat(['<s>'], list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: 'w' || x), ['</s>']) AS w FROM ids),
x AS (SELECT doc_id, trained, CASE WHEN i > 1 THEN w[i - 1] END AS z, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, trained, w, unnest(range(1, len(w))) AS i FROM w)),
u AS (SELECT b, count(*) AS c FROM x WHERE trained GROUP BY b),
h AS (SELECT a, count(*) AS c FROM x WHERE trained GROUP BY a),
g AS (SELECT a, b, count(*) AS c FROM x WHERE trained GROUP BY a, b),
j AS (SELECT z, a, b, count(*) AS c FROM x WHERE trained AND z IS NOT NULL GROUP BY z, a, b),
k AS (SELECT 2.0::DOUBLE ** unnest(range(-2, 15)) AS k),
k1 AS (SELECT coalesce(min(k), 16384) AS k FROM (SELECT k FROM k, h GROUP BY k HAVING sum(c * (k / (c - 1 + k))) >= (SELECT count(*) FROM g WHERE c = 1))),
k2 AS (SELECT coalesce(min(k), 16384) AS k FROM (SELECT k FROM k, g WHERE b <> '</s>' GROUP BY k HAVING sum(c * (k / (c - 1 + k))) >= (SELECT count(*) FROM j WHERE c = 1))),
t AS (SELECT sum(c)::BIGINT AS n, count(*) AS v, (SELECT k FROM k1) AS k1, (SELECT k FROM k2) AS k2 FROM u),
q AS (SELECT x.doc_id, x.trained, coalesce(u.c, 0) AS c, (coalesce(u.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS p,
        coalesce(h.c, 0) AS h1, coalesce(g.c, 0) AS c1, coalesce(y.c, 0) AS h2, coalesce(j.c, 0) AS c2, n, k1, k2
      FROM x CROSS JOIN t LEFT JOIN u ON u.b = x.b LEFT JOIN h ON h.a = x.a LEFT JOIN g ON g.a = x.a AND g.b = x.b LEFT JOIN g y ON y.a = x.z AND y.b = x.a LEFT JOIN j ON j.z = x.z AND j.a = x.a AND j.b = x.b),
r AS (SELECT *, CASE WHEN h1 > 0 THEN (c1 + k1 * p) / (h1 + k1) ELSE p END AS p1 FROM q)
SELECT doc_id, NOT trained AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens,
  round(sum(log10(p)), 6) AS base_score, round(sum(log10(CASE WHEN h2 > 0 THEN (c2 + k2 * p1) / (h2 + k2) ELSE p1 END)), 6) AS score
FROM r GROUP BY doc_id, trained
    """,
}
