"""Clip descriptions to mentions and actions with closed vocabularies.

Everything about one clip is in its own row, so normalisation is a projection: no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions import rules, text
from spanlens.functions.numeric import ratio

DESCRIPTION_TYPE = (
    "struct<summary:string,observed_facts:struct<visible_anatomy:array<string>,visible_instruments:array<string>,"
    "visible_objects:array<string>,actions:array<struct<subject:string,action:string,target:string>>,"
    "state_changes:array<string>,visual_evidence:array<string>>,"
    "medical_inferences:array<struct<inference:string,basis:string,confidence:string>>,"
    "uncertainties:array<struct<item:string,reason:string>>>"
)
VISIBLE_FIELDS = (("visible_anatomy", "anatomy"), ("visible_instruments", "instrument"), ("visible_objects", "object"))
NO_ARGUMENT = "unidentified object"
NO_ACTION = "unspecified action"
_SEP = "\u0001"


def _listed(value: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(value, F.array().cast(kind))


def _surface(surface: Column, source: Column, hint: Column) -> Column:
    return F.struct(surface.alias("surface"), source.alias("source_field"), hint.alias("hint"))


def _resolve(surfaces: Column, entity_rules) -> Column:
    """Add the squeezed surface, then (canonical, category) and their joint key."""
    clean = F.transform(surfaces, lambda s: F.struct(s.alias("s"), rules.squeeze(s["surface"]).alias("clean")))
    named = F.transform(
        clean, lambda c: F.struct(c.alias("c"), rules.entity(c["clean"], c["s"]["hint"], entity_rules).alias("e"))
    )
    return F.transform(
        named,
        lambda n: F.struct(
            n["c"]["s"]["surface"].alias("surface"),
            n["c"]["s"]["source_field"].alias("source_field"),
            n["c"]["clean"].alias("clean"),
            n["e"]["canonical"].alias("canonical"),
            n["e"]["category"].alias("category"),
            F.concat(n["e"]["category"], F.lit(_SEP), n["e"]["canonical"]).alias("key"),
        ),
    )


def normalize_clips(clips: DataFrame, entity_rules=None, action_rules=None, attribute_rules=None) -> DataFrame:
    """Add ``mentions`` and ``actions`` to rows with ``clip_id`` and a ``description`` struct.

    Visible surfaces come first, in field order. An action argument takes the first mention of its clip
    with the same category and concept; only if there is none a new mention is appended.
    """
    facts = F.col("description.observed_facts")
    no_hint = F.lit(None).cast("string")
    visible = F.concat(*[_tagged(_listed(facts[name]), name, hint) for name, hint in VISIBLE_FIELDS])
    acts = _listed(facts["actions"], "array<struct<subject:string,action:string,target:string>>")
    arguments = F.flatten(
        F.transform(
            acts,
            lambda a: F.array(
                _surface(F.coalesce(a["subject"], F.lit(NO_ARGUMENT)), F.lit("action_subject"), no_hint),
                _surface(F.coalesce(a["target"], F.lit(NO_ARGUMENT)), F.lit("action_target"), no_hint),
            ),
        )
    )
    df = (
        clips.withColumn("_visible", _resolve(visible, entity_rules))
        .withColumn("_arguments", _resolve(arguments, entity_rules))
        .withColumn("_argument_keys", F.transform("_arguments", lambda a: a["key"]))
    )
    fresh = F.array_except(F.col("_argument_keys"), F.transform("_visible", lambda v: v["key"]))
    appended = F.transform(fresh, lambda k: F.element_at("_arguments", F.array_position("_argument_keys", k).cast("int")))
    df = df.withColumn("_all", F.concat("_visible", appended)).withColumn("_keys", F.transform("_all", lambda m: m["key"]))

    # What actions say of a mention, apart from its attributes: those are only worked out where mentions are read.
    df = df.withColumn(
        "_named",
        F.transform(
            "_all",
            lambda m, i: F.struct(F.format_string("mention:%s:%03d", F.col("clip_id"), i).alias("mention_id"), m["canonical"].alias("canonical")),
        ),
    )

    def mention(m: Column, i: Column) -> Column:
        return F.struct(
            F.get("_named", i)["mention_id"].alias("mention_id"),
            i.alias("position"),
            m["surface"].alias("surface"),
            m["canonical"].alias("canonical"),
            m["category"].alias("category"),
            m["source_field"].alias("source_field"),
            rules.attributes(m["clean"], attribute_rules).alias("attributes"),
        )

    df = df.withColumn("mentions", F.transform("_all", mention))
    phrases = F.transform(
        acts,
        lambda a, i: F.struct(
            i.alias("i"),
            F.coalesce(a["action"], F.lit(NO_ACTION)).alias("original"),
            F.element_at("_argument_keys", (i * 2 + 1).cast("int")).alias("subject"),
            F.element_at("_argument_keys", (i * 2 + 2).cast("int")).alias("target"),
        ),
    )
    df = df.withColumn(
        "_phrases",
        F.transform(
            F.transform(phrases, lambda p: F.struct(p.alias("p"), rules.squeeze(p["original"]).alias("clean"))),
            lambda c: F.struct(
                c["p"]["i"].alias("i"),
                c["p"]["original"].alias("original"),
                rules.predicates(c["clean"], action_rules).alias("predicates"),
                F.element_at("_named", F.array_position("_keys", c["p"]["subject"]).cast("int")).alias("s"),
                F.element_at("_named", F.array_position("_keys", c["p"]["target"]).cast("int")).alias("t"),
            ),
        ),
    )

    def action_rows(p: Column) -> Column:
        def one(predicate: Column, j: Column) -> Column:
            return F.struct(
                F.format_string("action:%s:%03d:%02d", F.col("clip_id"), p["i"], j).alias("action_id"),
                predicate.alias("predicate"),
                p["original"].alias("original_action"),
                p["s"]["mention_id"].alias("subject_mention_id"),
                p["t"]["mention_id"].alias("target_mention_id"),
                p["s"]["canonical"].alias("subject_canonical"),
                p["t"]["canonical"].alias("target_canonical"),
            )

        return F.transform(p["predicates"], one)

    df = df.withColumn("actions", F.flatten(F.transform("_phrases", action_rows)))
    return df.drop("_visible", "_arguments", "_argument_keys", "_all", "_keys", "_named", "_phrases")


def _tagged(surfaces: Column, name: str, hint: str) -> Column:
    return F.transform(surfaces, lambda s: _surface(s, F.lit(name), F.lit(hint)))


def observation_records(clips: DataFrame) -> DataFrame:
    """Normalised clip records; medical inferences are kept aside and never used as facts."""
    facts = F.col("description.observed_facts")
    keep = [c for c in ("source_frames", "input_frames", "padding_frames", "prompt_version") if c in clips.columns]
    return clips.select(
        "clip_id",
        "video_id",
        "clip_index",
        "start_seconds",
        "end_seconds",
        F.col("description.summary").alias("summary"),
        "mentions",
        "actions",
        facts["state_changes"].alias("state_changes"),
        facts["visual_evidence"].alias("visual_evidence"),
        F.col("description.uncertainties").alias("uncertainties"),
        F.col("description.medical_inferences").alias("medical_inferences_excluded_from_graph"),
        *keep,
    )


_PLACE = ["video_id", "clip_id", "clip_index", "start_seconds", "end_seconds"]


def mention_rows(clips: DataFrame) -> DataFrame:
    """One row per mention.

    The outer generator with a test afterwards stops the optimiser from testing the array size first,
    which would compute the whole normalisation a second time.
    """
    rows = clips.select(*_PLACE, F.explode_outer("mentions").alias("m")).filter("m IS NOT NULL")
    return rows.select(*_PLACE, "m.*")


def action_rows(clips: DataFrame) -> DataFrame:
    """One row per action and predicate."""
    rows = clips.select(*_PLACE, F.posexplode_outer("actions").alias("position", "a")).filter("a IS NOT NULL")
    return rows.select(*_PLACE, "position", "a.*")


ROLE_TYPE = "array<struct<role:string,canonical:string,predicate:string>>"


def with_signature(clips: DataFrame, stop=None) -> DataFrame:
    """Add what neighbours are compared by: concept and predicate sets, roles, specificity.

    Roles keep only informative concepts. ``observation_specificity`` mixes informative mentions and
    recognised actions, ``argument_specificity`` is the share of informative action arguments.
    """
    stops = rules.strings(rules.vocab.STOP_CONCEPTS if stop is None else stop)
    telling = lambda c: ~F.array_contains(stops, c)
    sets = (
        clips.withColumn("concepts", F.array_sort(F.array_distinct("mentions.canonical")))
        .withColumn("predicates", F.array_sort(F.array_distinct("actions.predicate")))
        .withColumn("informative", F.array_except("concepts", stops))
    )
    roles = F.flatten(
        F.transform(
            "actions",
            lambda a: F.array(
                F.struct(F.lit("subject").alias("role"), a["subject_canonical"].alias("canonical"), a["predicate"].alias("predicate")),
                F.struct(F.lit("target").alias("role"), a["target_canonical"].alias("canonical"), a["predicate"].alias("predicate")),
            ),
        )
    )
    sets = sets.withColumn(
        "roles", F.array_sort(F.array_distinct(F.filter(roles, lambda r: telling(r["canonical"])))).cast(ROLE_TYPE)
    )
    mentions = ratio(F.size(F.filter("mentions", lambda m: telling(m["canonical"]))), F.size("mentions"))
    known = ratio(F.size(F.filter("actions", lambda a: a["predicate"] != "other_action")), F.size("actions"))
    arguments = F.size(F.filter("actions", lambda a: telling(a["subject_canonical"]))) + F.size(
        F.filter("actions", lambda a: telling(a["target_canonical"]))
    )
    return (
        sets.withColumn("observation_specificity", F.lit(0.7) * mentions + F.lit(0.3) * known)
        .withColumn("argument_specificity", ratio(arguments, 2 * F.size("actions")))
        .withColumn(
            "attribute_values",
            F.array_sort(F.array_distinct(F.flatten(F.transform("mentions", lambda m: F.flatten(F.map_values(m["attributes"])))))),
        )
        .withColumn("tokens", text.lexical_tokens(F.col("description.summary")))
    )
