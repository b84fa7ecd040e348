"""Each stage of the pipeline against plain Python on its own input."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from spanlens.llm import language  # noqa: E402
from spanlens.llm.common import staged  # noqa: E402
from tests.llm import rows as R  # noqa: E402


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = staged(stage(spark, docs, sf_dir), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name != "mixing":
            assert docs.columns == columns
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "line_dedup":
            want = R.kept_lines([(i, r.text) for i, r in before.items()])
            assert {i: r.text for i, r in after.items()} == {i: t for (i, old), t in want.items() if t or not old}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "ngram_jaccard_join":
            ids = sorted(before)
            found, _ = R.components([before[i].text for i in ids], 5, 80)
            assert set(after) == {ids[c] for c in found}
        elif name == "benchmark_decontamination":
            assert set(after) == {i for i, r in before.items() if not R.leaks(r.text, items)[1]}
        else:
            assert set(after) == set(before)
            assert sum(r.taken for r in after.values()) == pytest.approx(1.5 * sum(r.size for r in after.values()), abs=len(after))


def test_stages_take_awkward_rows(spark, sf_dir):
    for docs in (R.edge_docs(spark), R.edge_docs(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = staged(stage(spark, docs, sf_dir), name)
            assert name == "mixing" or docs.columns == columns


def test_one_of_equal_rows_stays(spark, sf_dir):
    docs = R.edge_docs(spark, [(1, R.A, "en", "a"), (1, R.A, "en", "a"), (2, R.A, "en", "b"), (3, None, "en", "b"), (3, None, "en", "b"), (None, R.A, "en", "c")])
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.text) == [(1, R.A)] and len(kept) == 3


def test_texts_of_several_languages_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {}
    for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").collect():
        words.setdefault(r.lang, []).extend(r.text.split())
    langs = sorted(words)[:3]
    assert len(langs) == 3
    # Even parts of three languages: no language holds one half.
    mixed = [(10**9 + i, " ".join(" ".join(words[x][40 * i : 40 * i + 40]) for x in langs)) for i in range(8)]
    marks = [(10**9 + 100, "1234 5678"), (10**9 + 101, "")]
    added = spark.createDataFrame(mixed + marks, "doc_id long, text string")
    both = docs.unionByName(added.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, both, sf_dir).where("doc_id >= 1000000000").collect()}
    assert kept == {i for i, _ in mixed}
    tagged = language.label_texts(added, language.train(docs)).where("doc_id < 1000000100").collect()
    assert all(r.language.score < 0.5 < r.language.certainty for r in tagged)
