"""The operators' queries over whole tables, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, chat, clusters, decontam, filter_audit, jaccard, kneser_ney, lengths, packing, rules, suffixes, urlrules

BPE_FILE, RANKS_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS_FILE)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items, exact or within the edit budget, in all documents."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learned from those not held out."""
    docs = _table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.train(docs))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard.link(_table(spark, sf_dir, "documents"), percent=90, width=3)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 100-byte strings that start earlier in the corpus."""
    return suffixes.deduplicate(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of every document."""
    return bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_file())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the learned list's verdict for every document."""
    docs = _table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, _table(spark, sf_dir, "labels")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes; equal texts stay together."""
    out = packing.shard(_table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The contract's rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return urlrules.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), v AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM v
"""


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one full of control strings, rendered and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string"))
    out = chat.parse(chat.format_conversations(rows))
    whole = F.array_join(F.transform("read_turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS body,
         replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n') AS head
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram of all documents with its running sums."""
    return lengths.limits(lengths.histogram(_table(spark, sf_dir, "documents"), tokenizer_file()))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, for all documents by source."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d
), f AS (
  SELECT part, doc_id, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
                        regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), g AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), k AS (
  SELECT * FROM (VALUES (1), (2), (3), (4), (5)) t(i)
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT ord, list_aggregate(list_transform(ord, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, k.i AS step, ord[k.i] AS own, ord[:k.i - 1] AS earlier FROM o, k
), r AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS hit, len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS many FROM g, s
), t AS (
  SELECT part, filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN hit AND many = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM t
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE by ranks, and back, of every document."""
    return byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks_file())


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components after three rounds from 16 hashed starts."""
    return clusters.cluster(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1, components=64, scale=64)


def _op13_sql() -> str:
    """One pair of views a round: nearest centroids, then floored means."""
    parts = [
        "v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "h AS (SELECT *, row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS j FROM v WHERE vec_id IS NOT NULL)",
        "c0 AS (SELECT j, q AS c FROM h WHERE j < 16)",
    ]
    gap = "list_sum(list_transform(list_zip(v.q, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for k in range(4):
        parts.append(f"a{k} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min(struct_pack(d := CAST(d AS BIGINT), j := j)) AS m FROM (SELECT v.r, v.vec_id, v.q, {gap} AS d, c.j FROM v, c{k} c) GROUP BY r)")
        if k < 3:
            parts.append(f"u{k} AS (SELECT j, list(mean ORDER BY i) AS c FROM (SELECT m.j AS j, i, CAST(floor(sum(q[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS mean FROM a{k}, range(1, 65) t(i) GROUP BY m.j, i) GROUP BY j)")
            parts.append(f"c{k + 1} AS (SELECT j, coalesce(u.c, o.c) AS c FROM c{k} o LEFT JOIN u{k} u USING (j))")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(m.j AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
       sha256(list_aggregate(c.c, 'string_agg', ',')) AS centroid_sha256
FROM a3 JOIN c3 c ON c.j = a3.m.j
"""


OP13_SQL = _op13_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_bpe": op2_bpe,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_quality_rules": op5_quality_rules,
        "op6_sharding": op6_sharding,
        "op7_url_filters": op7_url_filters,
        "op8_chat": op8_chat,
        "op9_token_counts": op9_token_counts,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_filter_audit": op11_filter_audit,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_centroid_clustering": op13_centroid_clustering,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filters": OP7_SQL, "op8_chat": OP8_SQL, "op11_filter_audit": OP11_SQL, "op13_centroid_clustering": OP13_SQL}
