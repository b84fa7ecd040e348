"""Documents to training mix: language, repeated lines, near duplicates, benchmark passages, target weights.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm import decontaminate, jaccard, language, line_dedup, mixing
from spanlens.llm.common import WORD_RE, fresh, row_key, staged, table

MIN_CERTAINTY = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are surely of learned languages: their highest posteriors have a mean above MIN_CERTAINTY.

    Texts that change between learned languages stay, however even their shares. Learns from the rows with a
    language. Null, empty and letterless texts go. If no row names a language, nothing can be judged and all
    rows stay. Equal rows are judged alike; an empty table stays empty.
    """
    model = language.train(docs)
    if not model.labels:
        return docs
    tagged = language.label_texts(docs, model)
    mark = F.col(f"`{tagged.columns[-1]}`")
    return tagged.where((mark["lang_pred"] != "und") & (mark["certainty"] > MIN_CERTAINTY)).select(docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of three-line passages; texts of which nothing is left go. ``n_chars`` follows the text."""
    cut = line_dedup.remove_repeats(docs)
    mark = F.col(f"`{cut.columns[-1]}`")
    cut = cut.where((mark["n_removed"] == 0) | (mark["n_removed"] < mark["n_lines"]))
    new = {"text": mark["text"], "n_chars": F.when(mark["n_removed"] == 0, F.col("n_chars")).otherwise(F.char_length(mark["text"]))} if "n_chars" in docs.columns else {"text": mark["text"]}
    return cut.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that with the smallest id, null last. Of equal rows one stays; texts without words all stay."""
    worded = F.coalesce(F.col("text").rlike(WORD_RE), F.lit(False))
    mark = fresh(docs, "__row")
    identity = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_key(*docs.columns).alias("row"))
    own = docs.where(worded).withColumn(mark, identity)
    groups = jaccard.near_duplicates(own, key=mark, shingle=5, percent=80)
    first = groups.where(F.col(mark) == F.col("component_id")).select(F.col(f"{mark}.row").alias("row")).distinct()
    kept = own.select(*docs.columns, F.col(f"{mark}.row").alias(mark)).join(first.withColumnRenamed("row", mark), mark, "left_semi").dropDuplicates([mark])
    return kept.select(docs.columns).unionByName(docs.where(~worded))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of ten words (or short item). Null and empty texts have none and stay; equal rows go or stay together."""
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.col(f"`{marked.columns[-1]}`.n_hit") == 0).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often and how far each document goes into the mix: one row for each (equal rows too), ``taken`` words in all. Null and empty texts take 0; an empty table gives none."""
    return mixing.mix(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]

# A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
