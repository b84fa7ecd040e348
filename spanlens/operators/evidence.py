"""Evidence recovery: spans stated in questions, and phase anchors from other questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions import timetext

PHASE_TASK = "Action Recognition"
WINDOWS_TYPE = "array<struct<start_seconds:double,end_seconds:double>>"
DIRECT_METHODS = ["direct_range", "direct_point"]


def _texts(questions: DataFrame) -> Column:
    others = []
    if "metadata" in questions.columns:
        others = [(name, F.try_element_at("metadata", F.lit(name))) for name in timetext.LEGACY_TEXT_FIELDS]
    return timetext.question_texts(F.col("question"), others)


def with_stated_span(questions: DataFrame) -> DataFrame:
    """Add ``stated`` (field, span): the first wording of the question that states a time, or null."""
    return questions.withColumn("stated", timetext.first_stated_span(_texts(questions)))


def phase_windows(stated: DataFrame, phase_task: str = PHASE_TASK) -> DataFrame:
    """Windows of named phases: questions of the phase task with a stated range, keyed by folded answer text."""
    ranged = stated.filter((F.col("task_name") == phase_task) & (F.col("stated.span.kind") == "range"))
    named = ranged.withColumn("_phase", timetext.option_text(F.col("options"), F.col("answer")))
    return named.filter(F.coalesce(F.col("_phase"), F.lit("")) != "").select(
        "video_id",
        timetext.fold_text(F.col("_phase")).alias("phase_key"),
        F.col("ord").alias("window_ord"),
        F.col("stated.span.start_seconds").alias("start_seconds"),
        F.col("stated.span.end_seconds").alias("end_seconds"),
    )


def phase_anchors(stated: DataFrame, windows: DataFrame, shortest_key: int = 4) -> DataFrame:
    """(video_id, qa_uid, phase_key, windows, first_seen) for questions whose text contains a phase key.

    Instead of testing every question against every phase of its recording, both sides meet on a gram:
    the first ``shortest_key`` letters of the key must occur in the text. Grams travel without the text;
    it joins the pairs that meet, and only those are tested.
    """
    keys = (
        windows.filter(F.length("phase_key") >= shortest_key)
        .groupBy("video_id", "phase_key")
        .agg(F.count(F.lit(1)).alias("windows"), F.min("window_ord").alias("first_seen"))
        .withColumn("_gram", F.substring("phase_key", 1, shortest_key))
    )
    folded = timetext.fold_text(F.array_join(F.transform(_texts(stated), lambda t: t["text"]), " "))
    asked = stated.filter(F.col("stated").isNull()).select("video_id", "qa_uid", folded.alias("_text"))
    starts = F.sequence(F.lit(1), F.length("_text") - (shortest_key - 1))
    grams = asked.filter(F.length("_text") >= shortest_key).select(
        "video_id",
        "qa_uid",
        F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("_text", i, F.lit(shortest_key))))).alias("_gram"),
    )
    return (
        grams.join(keys, ["video_id", "_gram"])
        .join(asked, ["video_id", "qa_uid"])
        .filter(F.contains("_text", "phase_key"))
        .select("video_id", "qa_uid", "phase_key", "windows", "first_seen")
    )


def anchor_windows(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """All windows of all anchors in long form, ordered by (first_seen, window_ord) per question.

    Kept as rows: one phase of one recording may have any number of windows.
    """
    return anchors.select("video_id", "qa_uid", "phase_key", "first_seen").join(windows, ["video_id", "phase_key"])


def recover_evidence(questions: DataFrame, phase_task: str = PHASE_TASK) -> DataFrame:
    """One row per question with method, confidence, the stated window and the matched phases.

    Needs (video_id, qa_uid, ord, question, answer, options, task_name) and optionally ``metadata``.
    Evidence is keyed by (video_id, qa_uid). The windows of weak anchors are in ``anchor_windows``.
    """
    stated = with_stated_span(questions)
    anchors = (
        phase_anchors(stated, phase_windows(stated, phase_task))
        .groupBy("video_id", "qa_uid")
        .agg(
            F.sum("windows").alias("_count"),
            F.array_join(F.array_sort(F.collect_set("phase_key")), ", ").alias("phase"),
        )
    )
    span = F.col("stated.span")
    direct = F.col("stated").isNotNull()
    weak = ~direct & F.col("_count").isNotNull()
    window = F.array(F.struct(span["start_seconds"].alias("start_seconds"), span["end_seconds"].alias("end_seconds")))
    joined = stated.join(anchors, ["video_id", "qa_uid"], "left")
    keep = [c for c in ("question", "answer", "task_name") if c in questions.columns]
    return joined.select(
        "video_id",
        "qa_uid",
        F.when(direct, F.concat(F.lit("direct_"), span["kind"])).when(weak, "phase_anchor").otherwise("unresolved").alias("method"),
        F.when(direct, "high").when(weak, "weak").otherwise("none").alias("confidence"),
        F.when(direct, window).otherwise(F.array().cast(WINDOWS_TYPE)).alias("windows"),
        F.when(direct, F.col("stated.field")).alias("source_field"),
        F.when(weak, F.col("phase")).alias("phase"),
        F.when(weak, F.col("_count")).otherwise(F.lit(0)).alias("candidate_count"),
        *keep,
    )


def recovery_report(evidence: DataFrame) -> DataFrame:
    """Counts of all questions, by method, by confidence, and by task and method, in one pass."""
    rows = evidence.withColumn("task_name", F.coalesce(F.nullif("task_name", F.lit("")), F.lit("unknown")))
    return rows.groupingSets(
        [[], ["method"], ["confidence"], ["task_name", "method"]], "method", "confidence", "task_name"
    ).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("method") != "unresolved").alias("recovered_any"),
        F.count_if(F.col("confidence") == "high").alias("recovered_high_confidence"),
        F.count_if(F.col("confidence") == "weak").alias("recovered_weak_anchor"),
        F.count_if(F.col("method") == "unresolved").alias("unresolved"),
    )


def direct_subset(evidence: DataFrame, only_missing_from_question: bool = False) -> DataFrame:
    """Questions with a stated time; optionally only those whose current wording lacks it."""
    rows = evidence.filter(F.col("method").isin(*DIRECT_METHODS))
    if only_missing_from_question:
        rows = rows.filter(F.coalesce("source_field", F.lit("question")) != "question")
    return rows


def with_query_text(evidence: DataFrame, questions: DataFrame, source: str = "question") -> DataFrame:
    """Add ``query_text``: the current question, or the wording that supplied the time.

    A missing older wording gives a null ``query_text`` and ``query_error``.
    """
    if source == "question":
        return evidence.withColumn("query_text", F.coalesce("question", F.lit(""))).withColumn(
            "query_error", F.lit(None).cast("string")
        )
    older = F.try_element_at("metadata", F.col("source_field"))
    current = F.coalesce("source_field", F.lit("question")) == "question"
    joined = evidence.join(questions.select("video_id", "qa_uid", "metadata"), ["video_id", "qa_uid"], "left")
    text = F.when(current, F.coalesce("question", F.lit(""))).when(F.trim(older) != "", older)
    return joined.withColumn("query_text", text).withColumn(
        "query_error", F.when(text.isNull(), F.lit("no_usable_query_text"))
    ).drop("metadata")


def leaking_questions(questions: DataFrame, question: str = "question") -> DataFrame:
    """Questions that still state a time after stripping."""
    stripped = timetext.strip_time_range(F.col(question))
    return questions.withColumn("stripped", stripped).filter(timetext.parse_time_span(F.col("stripped")).isNotNull())
