"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, language
from .common import crc_mod, learning, table
from .decontaminate import contaminated
from .jaccard_join import near_duplicates
from .line_dedup import line_dedup
from .onebit_search import build_index, nearest, usable
from .pii import pseudonymise
from .sentencepiece_scan import decode, encode
from .token_files import token_files
from .toxicity import learn, score


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The session's setting with the secret key of pseudonyms; without it the query uses the public trial key.
PII_KEY, TRIAL_KEY = "spark.tesserae.pii.key", "public trial key"


def op2_pii(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    key = key or spark.conf.get(PII_KEY, TRIAL_KEY)
    return pseudonymise(table(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_pii")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without doc_id is scored; it counts as not held out and no label is learned with it."""
    docs, (known, held_out) = table(spark, sf_dir, "documents"), learning(crc_mod("doc_id", 3), 1)
    out = score(docs, learn(docs, table(spark, sf_dir, "labels"), known))
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"), F.col("toxic_hits").alias("hits"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without doc_id is scored; it counts as not held out and its text is not learned from."""
    docs, (known, held_out) = table(spark, sf_dir, "documents"), learning(crc_mod("doc_id", 7), 2)
    model = class_lm.train(docs.where(known))
    out = class_lm.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(build_index(vectors), usable(vectors).where("vec_id % 50 = 0"), k=5)


OP5_SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents")
    return token_files(docs, tokenizer_path, lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}, "ids_crc32 long")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without doc_id gets a language; it counts as not held out and is not learned from."""
    docs, (known, held_out) = table(spark, sf_dir, "documents"), learning(crc_mod("doc_id", 4), 2)
    out = language.identify(docs, language.learn(docs, known))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip (decoding gives the
    text back), for every whole text."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def digest(lists: pa.Array) -> pa.Array:
        ends, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
        return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())

    out = decode(encode(table(spark, sf_dir, "documents"), model_path), model_path)
    same = F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded"))
    return out.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.arrow_udf(digest, "long")("piece_ids").alias("ids_crc32"), same.alias("round_trip"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keep_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, pos, line, keep_doc IS NOT NULL AND doc_id <> keep_doc AS dropped FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_pii": op2_pii,
        "op3_toxicity": op3_toxicity,
        "op4_class_lm": op4_class_lm,
        "op5_onebit_search": op5_onebit_search,
        "op6_token_files": op6_token_files,
        "op7_language": op7_language,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_line_dedup": op9_line_dedup,
        "op10_jaccard_join": op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_onebit_search": OP5_SQL, "op9_line_dedup": OP9_SQL}
