"""Registered queries of the training-text operators, and the SQL they are checked against."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm import chat, decontaminate, jaccard, language, language_model, line_dedup, mixing, quality, ranking, secrets, token_counts, toxicity, whitening
from spanlens.llm.common import shared_folder, table
from spanlens.llm.oracles import ORACLES  # noqa: F401

TOKENIZER_FILE = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.is_held_out(F.col("doc_id")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. The cache starts empty here, so that each run measures the whole work."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = f"{shared_folder(spark)}/token-cache-{uuid.uuid4().hex}"
    return token_counts.token_counts(docs, cache, tokenizer_path(), limit=4096).select("doc_id", "tokens.*")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that quotes the template, read back from the formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", quoting), (-7, 1, "assistant", quoting)], "conv_id bigint, turn bigint, role string, text string")
    nodes = chat.linear(rows.unionByName(extra))
    made = chat.format_trees(nodes, "conv_id", "node", "parent")

    @F.arrow_udf("struct<n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string>")
    def read(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, marked in zip(texts.to_pylist(), spans.to_pylist()):
            turns = chat.read_turns(text)
            learned = chat.read_learned(text, [(s["start"], s["end"]) for s in marked])
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            out.append({
                "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(),
                "loss_chars": len(learned), "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(),
            })
        return pa.array(out, pa.struct([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string())]))

    back = made.select("conv_id", read("formatted", "spans").alias("r"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    return back.select("conv_id", "r.*", "formatted_chars")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "deduped.n_lines", "deduped.n_removed", F.col("deduped.text").alias("text"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    leak = F.col("leaks")
    return marked.select(
        "doc_id",
        leak["n_words"].alias("n_words"),
        leak["n_hit"].alias("n_hit"),
        F.size(leak["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"),
        (leak["n_hit"] > 0).alias("contaminated"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    m = F.col("measures")
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("secrets")

    def number(kind: str):
        return F.size(F.filter(s["base"], lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    rank = F.create_map(*[F.lit(v) for pair in secrets.ORDER.items() for v in pair])
    every = F.array_sort(F.transform(F.concat(s["base"], s["added"]), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(joined(s["base"]), 256).alias("base_sha256"), joined(every).alias("spans"), s["max_guess_log10"].alias("max_guess_log10"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.is_held_out(F.col("doc_id"))
    model = language.train(docs.where(~held_out))
    tagged = language.label_texts(docs.select("doc_id", "text"), model)
    return tagged.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), k=10)
    return found.select("item_id", "rank", "doc_id", "score")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.is_held_out(F.col("doc_id"))
    model = toxicity.train(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs, model)
    score = F.col("toxicity.score")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector and component. A squared length beyond a long is null here; the operator gives it as a decimal."""
    made = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=32)
    w = F.col("whitened")
    return made.select(
        "vec_id", w["n"].alias("n"), w["deviation"].try_cast("bigint").alias("deviation"), w["identity_error"].alias("identity_error"),
        F.posexplode(F.arrays_zip(w["values"].alias("whitened"), w["explained"].alias("explained"))).alias("place", "own"),
    ).select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "own.whitened", "own.explained", "identity_error")


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_lm_scores": op2_lm_scores,
    "op3_token_counts": op3_token_counts,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_scans": op8_secret_scans,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_lexical_search": op11_lexical_search,
    "op12_toxicity": op12_toxicity,
    "op13_embedding_whitening": op13_embedding_whitening,
}
