"""Callers' columns that bear the names of helper columns stay as they are."""

import time

from pyspark.sql import functions as F

from spanlens.llm import decontaminate, language, line_dedup, secrets, token_counts
from spanlens.llm.common import shared_folder
from tests.llm import rows as R
from tests.llm.test_operators import ITEMS, tokenizer

NAMES = ["__n", "__bytes", "__places", "__key", "__spans", "__items", "__base", "__row", "spans", "items", "content_digest", "cost", "value", "found"]


def test_helper_columns_leave_callers_columns_alone(spark):
    docs = R.edge_docs(spark).select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)]).cache()
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    made = [
        token_counts.token_counts(docs, f"{shared_folder(spark)}/clash-{time.time_ns()}", tokenizer()), line_dedup.remove_repeats(docs),
        decontaminate.contamination(docs, bench, block_windows=3), secrets.find_secrets(docs),
    ]
    for df in made:
        assert df.columns[:-1] == docs.columns
        got = df.select(*docs.columns).collect()
        assert len(got) == len(R.TEXTS) and all(tuple(r)[2:] == tuple(range(len(NAMES))) for r in got)


def test_number_signs_are_no_letters_and_null_ids_teach(spark):
    for text in ("10 \u00bd", "\u00b2 \u2462", "\u2167 12", "", "1234 !!"):
        assert not language.folded(text)
    assert language.folded("10 \u00bd a")
    held = spark.createDataFrame([(None,), (3,)], "i bigint").select(language.is_held_out(F.col("i")).alias("h")).collect()
    assert all(r.h is not None for r in held)
