"""Scores of the language model against counts in plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlens.llm import language_model
from tests.llm import rows as R


def quantised(count):
    return float(language_model.level_value(language_model.level(count))) if count else 0.0


def plain_scores(rows, held, least):
    """score of each (id, text), with pairs that training texts have ``least`` times or more."""
    tokens = [[*R.SPACED.findall(R.low(t)), None] for _, t in rows]
    train = [ts for (i, _), ts in zip(rows, tokens) if i not in held]
    words = Counter(w for ts in train for w in ts)
    pairs = Counter(p for ts in train for p in zip([None, *ts], ts))
    norm, mix = sum(words.values()) + len(words) + 1, language_model.MIX
    out = {}
    for (i, _), ts in zip(rows, tokens):
        total = 0.0
        for v, w in zip([None, *ts], ts):
            lower, before = (quantised(words[w]) + 1) / norm, quantised(words[v])
            pair = quantised(pairs[v, w]) if pairs[v, w] >= least else 0.0
            total += math.log10(mix * min(1.0, pair / before) + (1 - mix) * lower if before else lower)
        out[i] = total
    return out


def texts(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(rng.randrange(1, 120)))) for i in range(n)]


@pytest.mark.parametrize("bucket_bytes", [8_000_000, 1_000])
def test_no_pair_leaves_the_model(spark, monkeypatch, bucket_bytes):
    """At any number of buckets no count reads lower than it is, and a bounded filter is refused rather than thinned."""
    monkeypatch.setattr(language_model, "BUCKET_BYTES", bucket_bytes)
    rows = texts(600)
    held = {i for i, _ in rows if i % 7 == 2}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain_scores(rows, held, 2)
    got = {r.doc_id: r.score for r in language_model.score(docs, F.col("doc_id") % 7 == 2).collect()}
    assert all(got[i] >= want[i] - 1e-9 for i in want)
    with pytest.raises(ValueError):
        language_model.build_filter(language_model.counted(docs, 16), 1 << 12, 16)


def test_pairs_seen_once_count(spark):
    rows = texts(600)
    held = {i for i, _ in rows if i % 7 == 2}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, without = plain_scores(rows, held, 1), plain_scores(rows, held, 2)
    got = {r.doc_id: r.score for r in language_model.score(docs, F.col("doc_id") % 7 == 2).collect()}
    assert all(got[i] >= want[i] - 1e-9 for i in want) and any(want[i] > without[i] + 1 for i in want)
    # Only false positives of the filter lie above.
    assert sum(got.values()) - sum(want.values()) < 0.2 * (sum(want.values()) - sum(without.values()))
