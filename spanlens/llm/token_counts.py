"""Token counts through a digest cache: texts are encoded once per content and tokenizer version, ever."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.common import fresh, staged

CACHE_SCHEMA = "content_digest binary, n_tokens bigint, tokenizer_digest string"
BATCH_CHARS = 2_000_000


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the way it is called; a change of either makes other cache entries."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no special tokens|v1").hexdigest()


def normalised(text: Column) -> Column:
    """Null counts as empty. Nothing else is changed: any other folding could change the count."""
    return F.coalesce(text, F.lit(""))


def _loaded(path: str):
    """A function from texts to lengths, for either library."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def encoder(path: str):
    """Arrow UDF: the number of tokens of each text. The vocabulary is loaded once per Python worker."""
    models: dict[str, object] = {}

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        if path not in models:
            models[path] = _loaded(path)
        values, out, at = texts.to_pylist(), [], 0
        sizes = np.cumsum([len(v) for v in values] or [0])
        while at < len(values):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + BATCH_CHARS, "right")))
            out += models[path](values[at:end])
            at = end
        return pa.array(out, pa.int64())

    return count


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; a missing cache is empty, entries stored twice count once."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    kept = cache.where(F.col("tokenizer_digest") == version)
    return kept.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with one more struct column ``tokens``: n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Contents are joined to the cache by digest; each distinct content that misses is encoded once and
    appended before the counts are read back. Copies meet in a partial aggregate, so a content that a
    third of all rows share leaves each map task once. The cache may be shared by any number of runs.

    Null and empty texts: 0 bytes, 0 tokens. Very long texts are encoded whole. Repeated rows: each gets its count. No rows: no rows, and
    nothing is appended. A column called ``tokens`` stays; the new one is then ``tokens_1``.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    out, digest, number, size = (fresh(docs, n) for n in ("tokens", "content_digest", "__n", "__bytes"))
    content = normalised(F.col(f"`{text}`"))
    contents = docs.select(F.unhex(F.sha2(content, 256)).alias("content_digest"), content.alias("content"))
    misses = contents.groupBy("content_digest").agg(F.first("content").alias("content"))
    misses = misses.join(read_cache(spark, cache_path, version), "content_digest", "left_anti")
    counted = misses.select("content_digest", encoder(tokenizer_path)("content").alias("n_tokens"), F.lit(version).alias("tokenizer_digest"))
    counted.write.mode("append").partitionBy("tokenizer_digest").parquet(cache_path)
    # Staged, so that both sides of the join are plain exchanges and a content of many rows can be split.
    counts = staged(read_cache(spark, cache_path, version), "counts").select(F.col("content_digest").alias(digest), F.col("n_tokens").alias(number))
    keyed = docs.withColumn(digest, F.unhex(F.sha2(content, 256))).withColumn(size, F.octet_length(content).cast("bigint"))
    joined = keyed.join(counts, digest, "left")
    result = F.struct(F.col(size).alias("n_bytes"), F.col(number).alias("n_tokens"), (F.col(number) > limit).alias("over_limit"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias(out))
