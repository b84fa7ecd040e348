"""The training sample of the language model."""

import numpy as np
from pyspark.sql import functions as F

from spanlens.llm import language


def test_copies_teach_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").distinct()
    copied = docs.withColumn("n", F.when(F.crc32("text") % 9 == 0, 40).otherwise(1)).selectExpr("text", "lang", "explode(sequence(1, n)) AS i")
    once, often = language.train(docs, per_label=30, rounds=1), language.train(copied, per_label=30, rounds=1)
    assert once.labels == often.labels and np.array_equal(once.lexicon, often.lexicon)
    assert np.allclose(once.weights, often.weights, atol=1e-5) and np.allclose(once.transitions, often.transitions, atol=1e-5)
