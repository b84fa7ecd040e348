"""Steps that must not do work per pattern, frame or sample that no result needs."""

import random
import re

from pyspark.sql import functions as F

from spanlens.catalog.timeline import _with_frames
from spanlens.functions import rules, text, vocab
from spanlens.operators import events, graphquery, windows


def _patterns():
    said = [text._phrase_pattern([p.replace("_", " "), *vocab.ACTION_ALIASES.get(p, [])]) for p in vocab.ACTION_VOCABULARY]
    return [r[0] for t in (vocab.ENTITY_RULES, vocab.ENTITY_FALLBACKS, vocab.ACTION_RULES, *vocab.ATTRIBUTE_RULES.values()) for r in t] + said


def test_every_rule_needs_words_and_none_is_lost():
    words = sorted({w for p in _patterns() for w in re.findall("[a-z-]+", p)} | {"and", "through", "around", "red", "fluid", "tissue", "is", "taut"})
    ends = ["", "s", "ed", "ing", "es", "e", "like"]
    pick = random.Random(3)
    fitted = 0
    for _ in range(3000):
        said = " ".join(pick.choice(words) + pick.choice(ends) for _ in range(6))
        for p in _patterns():
            assert rules.needed(p)
            if re.search(p, said):
                fitted += 1
                assert any(w in said for w in rules.needed(p)), (p, said)
    assert fitted > 1000


def test_unknown_constructs_need_no_words():
    for p in (r"(?i)Blood", r"\p{L}+ cut", r"[a[bc]]d", r"\Qa.b\E", "(?:cut)?", "a|b*", r"x*+y", "[abc]"):
        assert rules.needed(p) == (), p


def test_java_only_rules_still_apply(spark):
    own = [(r"(?i)\bSCALPEL\b", "blade", "instrument"), (r"\bclip\b", "clip_like_object", "object")]
    rows = spark.createDataFrame([("a scalpel",), ("the clip",), ("nothing",), (None,)], "t string")
    got = [r[0] for r in rows.select(rules.rule_canonical(F.col("t"), own)).collect()]
    assert got == ["blade", "clip_like_object", None, None]


def test_questions_meet_entity_rules_across_punctuation(spark):
    terms = spark.sql("SELECT 'v' AS video_id, map('cut', 1L) AS action_df, map('red_fluid', 1L, 'hand', 1L) AS concept_df, 3L AS event_total")
    asked = spark.createDataFrame([("1", "v", "Was red, fluid seen?"), ("2", "v", "A gloved hand, or (blood)?"), ("3", "v", "Zzz calibrated")], "question_id string, video_id string, question string")
    got = {r.question_id: list(r.query_concepts) for r in graphquery.normalize_questions(asked, terms).collect()}
    assert got == {"1": ["red_fluid"], "2": ["hand", "red_fluid"], "3": []}


def test_continuity_names_each_step_once(spark):
    side = "struct<predicates:array<string>,informative:array<string>,concepts:array<string>,roles:array<struct<role:string,canonical:string,predicate:string>>>"
    rows = spark.createDataFrame([], f"a {side}, b {side}").select(events.continuity(F.col("a"), F.col("b")).alias("c"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("arrays_overlap") == 1
    assert plan.count("array_intersect") <= 4


def test_frames_of_clips_nobody_asked_for_are_not_made(spark):
    clips = spark.range(20).select(F.lit(7).alias("video_id"), F.col("id").alias("clip_index"), F.lit(2).alias("sampled_frame_count"))
    paths = F.when(F.col("clip_index") > 4, F.raise_error(F.lit("made")).cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    good, bad = windows.select_clips_by_index(clips.withColumn("frame_paths", paths), [3, 0], 2)
    assert [(r.selection_index, r.clip_index, r.frame_paths) for r in good.orderBy("selection_index").collect()] == [(0, 3, ["a", "b"]), (1, 0, ["a", "b"])]
    assert bad.count() == 0


def test_even_clips_by_position_and_size_of_the_recording(spark):
    rows = [(v, 5000 * i, f"{v}-{i}") for v, n in ((1, 12), (2, 3), (3, 2)) for i in range(n)]
    clips = spark.createDataFrame(rows, "video_id int, clip_index long, name string")
    chosen, short = windows.select_even_clips(clips, 3)
    got = sorted((r.video_id, r.selection_index, r.name) for r in chosen.collect())
    assert got == [(1, 0, "1-0"), (1, 1, "1-6"), (1, 2, "1-11"), (2, 0, "2-0"), (2, 1, "2-1"), (2, 2, "2-2")]
    assert [tuple(r) for r in short.select("video_id", "clips", "reason").collect()] == [(3, 2, "too_few_clips")]
    assert "posexplode" not in chosen._jdf.queryExecution().optimizedPlan().toString()


def test_frame_names_are_not_formatted_one_by_one(spark):
    clips = spark.range(1).select(F.format_string("c%05d", "id").alias("clip_id"), F.lit(3).cast("long").alias("sampled_frame_count"))
    named = _with_frames(clips).select("frame_paths")
    assert named.first()[0] == [f"c00000/frame_00{i}.jpg" for i in range(3)]
    assert "frame_%03d" not in named._jdf.queryExecution().optimizedPlan().toString()


def test_owners_of_frames_are_hashed(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 60.0), (1, 1, 40.0, 100.0), (1, -1, 0.0, 60.0)], "video_id int, window_index long, start_seconds double, end_seconds double")
    out = windows.sample_targets(rows, F.lit(0.05), 4)
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, 0, 0, 0), (1, 1, 0, 1), (1, 2, 1, 0), (1, 3, 1, 1), (1, 4, 1, 2), (1, 5, 1, 3)]
    assert {f.name: f.dataType.simpleString() for f in out.schema} == {"video_id": "int", "frame_number": "bigint", "chunk_index": "bigint", "sample_index": "int"}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
