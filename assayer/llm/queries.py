"""The numbered queries: operators applied to their whole tables."""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import caps, lempel_ziv, log_bilinear, merkle, minmax_dedup, packing, periodic_runs, secrets_crf
from assayer.llm import token_files, toxicity, warc, winnow, word_bpe


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.score(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv.digests(lempel_ziv.duplicate_words(_table(spark, sf_dir, "documents")))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = word_bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return word_bpe.digests(encoded)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"),
                                  packing.ranks_path(vocabulary("byte_bpe_50k.json")))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets_crf.scan(docs, secrets_crf.train(docs))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("text", periodic_runs.looped(F.col("doc_id"), F.col("text")))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs, with_text=False))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the CRC-32 of the id, the leaf that is checked has one more in ``n_chars``."""
    docs = _table(spark, sf_dir, "documents")
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = F.when(altered, merkle.leaf_digest(*more)).otherwise(
        merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS]))
    return merkle.digests(merkle.verify(merkle.manifest(docs, claimed=claimed)))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"),
                                  packing.ranks_path(vocabulary("byte_bpe_50k.json")))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_lm_scoring, op3_substring_dedup, op4_bpe_encode_decode, op5_best_fit_packing,
    op6_warc, op7_embedding_near_dedup, op8_toxicity, op9_secret_scan, op10_fingerprints,
    op11_periodic_runs, op12_merkle_manifest, op13_token_files)}
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || {0}, '-')"
_PARENTS = """SELECT tree, h + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM {0} WHERE n > 1 GROUP BY tree, h, pos // 2, n"""
_STEP = """SELECT w.row_id, w.tree, w.h + 1, w.pos // 2, w.proof || coalesce(s.digest, ''),
    CASE WHEN s.digest IS NULL THEN sha256(w.fold) WHEN w.pos % 2 = 0 THEN sha256(w.fold || s.digest)
         ELSE sha256(s.digest || w.fold) END
  FROM {0} w JOIN {1} o ON o.tree = w.tree AND o.h = w.h AND o.pos = w.pos AND o.n > 1
  LEFT JOIN {1} s ON s.tree = w.tree AND s.h = w.h AND s.pos = xor(w.pos, 1)"""
ORACLE_SQL: dict[str, str] = {"op12_merkle_manifest": f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (
  SELECT row_number() OVER () AS row_id, doc_id, '=' || lang AS named, *  EXCLUDE (doc_id),
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 0 AS altered
  FROM documents, crc),
leaves AS (
  SELECT row_id, doc_id, coalesce(named, '') AS tree, sha256({" || ".join(map(_FIELD.format, merkle.FIELDS))}) AS leaf,
    CASE WHEN altered THEN sha256({" || ".join(map(_FIELD.format, ("doc_id", "source", "lang", "(n_chars + 1)", "text")))}) END AS other
  FROM named),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
nodes(tree, h, pos, digest, n) AS (
  SELECT tree, 0, pos, leaf, n FROM placed UNION ALL {_PARENTS.format("nodes")}),
subroots AS (
  SELECT tree AS lang_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper(tree, h, pos, digest, n) AS (
  SELECT 'all', 0, pos, digest, n FROM subroots UNION ALL {_PARENTS.format("upper")}),
walk(row_id, tree, h, pos, proof, fold) AS (
  SELECT row_id, tree, 0, pos, '', coalesce(other, leaf) FROM placed UNION ALL {_STEP.format("walk", "nodes")}),
reached AS (SELECT w.* FROM walk w JOIN nodes o ON o.tree = w.tree AND o.h = w.h AND o.pos = w.pos WHERE o.n = 1),
climb(row_id, tree, h, pos, proof, fold) AS (
  SELECT r.row_id, 'all', 0, s.pos, r.proof, r.fold FROM reached r JOIN subroots s ON s.lang_tree = r.tree
  UNION ALL {_STEP.format("climb", "upper")}),
ended AS (SELECT c.*, o.digest AS root FROM climb c JOIN upper o ON o.h = c.h AND o.pos = c.pos WHERE o.n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, e.root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root,
       e.fold = e.root AS verified
FROM placed p JOIN ended e USING (row_id) JOIN subroots s ON s.lang_tree = p.tree"""}
