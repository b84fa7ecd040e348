"""Checks on tables of raw model replies. Model calls themselves are outside of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.functions import text, vocab

EVENT_ID = r"event:[A-Za-z0-9_-]+:\d{5}"


def first_choice(questions: DataFrame, options: str = "options") -> DataFrame:
    """Control reader: the label of the first option; no options give an error."""
    label = F.try_element_at(text.choice_labels(F.col(options)), F.lit(1))
    return questions.withColumn("prediction", label).withColumn(
        "error", F.when(label.isNull(), F.lit("options_required"))
    )


def read_choices(replies: DataFrame, reply: str = "reply", options: str = "options") -> DataFrame:
    """Choice and rationale from replies that should be a JSON object; every failure is named."""
    body = replies.withColumn("_json", text.json_object_text(F.col(reply)))
    choice = F.upper(text.strip(F.get_json_object("_json", "$.choice")))
    body = body.withColumn("_choice", choice).withColumn("_labels", text.choice_labels(F.col(options)))
    error = (
        F.when(F.col("_json").isNull(), "no_json_object")
        .when(F.col("_choice").isNull(), "no_choice")
        .when(~F.array_contains("_labels", F.col("_choice")), "choice_not_offered")
    )
    return body.select(
        *replies.columns,
        F.when(error.isNull(), F.col("_choice")).alias("prediction"),
        F.when(error.isNull(), F.coalesce(F.get_json_object("_json", "$.rationale"), F.lit(""))).alias("rationale"),
        error.alias("error"),
    )


def check_descriptions(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Add the JSON body of a clip description and what is wrong with it (null when complete)."""
    body = replies.withColumn("body", text.json_object_text(F.col(reply)))
    observed = F.get_json_object("body", "$.observed_facts")
    missing = text.missing_keys(F.col("body"), vocab.DESCRIPTION_KEYS)
    is_object = F.schema_of_variant(F.try_parse_json(observed)).startswith("OBJECT")
    nested = text.missing_keys(observed, vocab.OBSERVED_KEYS)
    error = (
        F.when(F.col("body").isNull(), F.lit("no_json_object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))
        .when(~F.coalesce(is_object, F.lit(False)), F.lit("observed_facts_not_an_object"))
        .when(F.size(nested) > 0, F.concat(F.lit("observed_missing:"), F.array_join(nested, ",")))
    )
    return body.withColumn("error", error)


def merge_rewrites(first: DataFrame, rewrites: DataFrame, key: str = "clip_id") -> DataFrame:
    """Replace summary and inferences where the rewrite has both; else keep the first reply."""
    body = text.json_object_text(F.col("reply"))
    parsed = rewrites.select(key, body.alias("_json"))
    parsed = parsed.select(
        key,
        F.get_json_object("_json", "$.summary").alias("_summary"),
        F.get_json_object("_json", "$.medical_inferences").alias("_inferences"),
        (F.size(F.array_except(F.array(F.lit("summary"), F.lit("medical_inferences")), F.json_object_keys("_json"))) == 0).alias("_both"),
    )
    use = F.coalesce("_both", F.lit(False))
    return first.join(parsed, key, "left").select(
        *[c for c in first.columns if c not in ("summary", "medical_inferences")],
        F.when(use, F.col("_summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(use, F.col("_inferences")).otherwise(F.col("medical_inferences")).alias("medical_inferences"),
        use.alias("rewritten"),
    )


def repair_event_ids(replies: DataFrame, known_events: DataFrame, top_events: int, reply: str = "reply") -> DataFrame:
    """Event ids a reranker named, kept if known (as written or with its number padded to 5 digits).

    ``replies`` has (question_id, video_id, reply), ``known_events`` (video_id, event_id). Ids are
    looked up by an equi join, never against a list of all events. Gives one row per reply with the
    first ``top_events`` distinct ids in reply order, or an error.
    """
    body = text.json_object_text(F.col(reply))
    ids_json = F.get_json_object("_json", "$.event_ids")
    listed = F.when(ids_json.startswith("["), F.from_json(ids_json, "array<string>")).otherwise(F.array(ids_json))
    fallback = F.regexp_extract_all(F.col(reply), F.lit(f"({EVENT_ID})"), 1)
    raw = replies.withColumn("_json", body).withColumn(
        "_ids", F.when(F.col("_json").isNull(), fallback).when(ids_json.isNotNull(), listed)
    )
    asked = raw.select("question_id", "video_id", F.posexplode("_ids").alias("_pos", "_id"))
    number = F.regexp_extract("_id", r"^event:[A-Za-z0-9_-]+:(\d+)$", 1)
    stem = F.regexp_extract("_id", r"^(event:[A-Za-z0-9_-]+:)\d+$", 1)
    padded = F.when(number != "", F.concat(stem, F.format_string("%05d", number.try_cast("long"))))
    tries = asked.withColumn(
        "_try", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("_id").alias("id")), F.struct(F.lit(1).alias("n"), padded.alias("id"))))
    )
    found = tries.join(
        known_events.select("video_id", F.col("event_id").alias("_known")),
        (tries["video_id"] == known_events["video_id"]) & (F.col("_try.id") == F.col("_known")),
        "left_semi",
    )
    chosen = found.groupBy("video_id", "question_id", "_pos").agg(F.min("_try").alias("_t"))
    firsts = chosen.groupBy("video_id", "question_id", F.col("_t.id").alias("event_id")).agg(F.min("_pos").alias("_pos"))
    kept = firsts.groupBy("video_id", "question_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("_pos", "event_id"))), 1, top_events).alias("_e")
    )
    return replies.select("question_id", "video_id").join(kept, ["video_id", "question_id"], "left").select(
        "question_id",
        "video_id",
        F.coalesce(F.col("_e.event_id"), F.array().cast("array<string>")).alias("event_ids"),
        F.when(F.col("_e").isNull(), F.lit("no_valid_event_ids")).alias("error"),
    )
