"""The registered queries of this folder and their SQL.

Each query applies one operator to its whole table and derives the columns of
its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.langid import held_out, learn, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(~held_out(2, 4)))
    return predict(docs.select("doc_id", held_out(2, 4).alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import BASE, CURRENT, POLICIES, ledger, verdict

    book = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~verdict("fail_bits", BASE)).alias("base_failed"), verdict("fail_bits", POLICIES[CURRENT]).alias("kept"), "n_lines", "fail_bits")


ORACLE_SQL["op4_quality"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), tri AS (
  SELECT k, i, list_value(w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM tri) WHERE c > 1
), cov AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY k
), ln AS (
  SELECT k, count(*) AS n, count(DISTINCT x) AS u
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY k
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(ln.n - ln.u, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(ln.n, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN ln USING (k) LEFT JOIN cov USING (k)
), b AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits
FROM b
"""


@query
def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_only=True)


ORACLE_SQL["op10_substring"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, hash(list_slice(w, i, i + 49)) AS h, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 48)) AS i FROM d WHERE len(w) >= 50)
), first AS (
  SELECT h, g, min(doc_id) AS f FROM win GROUP BY h, g HAVING count(*) > 1
), hit AS (
  SELECT DISTINCT doc_id, i FROM win JOIN first USING (h, g) WHERE doc_id > f
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit)
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.minhash import groups

    found = groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE_SQL["op5_minhash"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(CAST(len(w) AS BIGINT) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a
)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""


@query
def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.ppm import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.langid import held_out
    from quire.llm.toxicity import learn, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = predict(docs.select("doc_id", held_out(1, 3).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import archive_and_read

    records = archive_and_read(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    # A response whose payload does not have its digest has none here.
    digest = F.when(F.coalesce("intact", F.lit(True)), F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL["op6_warc"] = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
