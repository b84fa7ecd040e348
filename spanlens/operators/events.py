"""Temporal events: continuity of neighbouring clips, merging, support, representative clips."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions import rules, text, vocab
from spanlens.functions.numeric import exact_round, jaccard, ratio
from spanlens.plans.ordered import RANGE_WIDTH, capped_runs

DETAIL_FIELDS = [
    "action_relation",
    "exact_predicates",
    "compatible_transitions",
    "supported_transitions",
    "shared_informative_concepts",
    "shared_action_roles",
]


def _transition_table(support: Mapping[tuple[str, str], Sequence[str]]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), rules.strings(s).alias("support"))
            for (a, b), s in sorted(support.items())
        ]
    )


def _role(role: Column, canonical: Column, left: Column, right: Column) -> Column:
    return F.struct(
        role.alias("role"), canonical.alias("canonical"), left.alias("from_predicate"), right.alias("to_predicate")
    )


def continuity(first: Column, second: Column, support=None) -> Column:
    """How two neighbouring clip signatures hang together.

    The action part is 1 for a shared predicate whose role and concept also agree, 0.8 for an allowed
    action sequence supported by a shared concept, else 0.
    """
    table = _transition_table(support or vocab.TRANSITION_SUPPORT)

    def moved(t: Column) -> Column:
        partner = lambda r: F.struct(
            r["role"].alias("role"), r["canonical"].alias("canonical"), t["right"].alias("predicate")
        )
        kept = F.filter(
            first["roles"], lambda r: (r["predicate"] == t["left"]) & F.array_contains(second["roles"], partner(r))
        )
        return F.transform(kept, lambda r: _role(r["role"], r["canonical"], t["left"], t["right"]))

    same_roles = F.filter(
        first["roles"], lambda r: F.array_contains(second["predicates"], r["predicate"]) & F.array_contains(second["roles"], r)
    )
    # Each stage names the results of the one before it, so nothing is computed twice.
    met = F.struct(
        F.array_sort(F.array_intersect(first["predicates"], second["predicates"])).alias("exact"),
        F.array_sort(F.array_intersect(first["informative"], second["informative"])).alias("shared"),
        F.filter(
            table, lambda t: F.array_contains(first["predicates"], t["left"]) & F.array_contains(second["predicates"], t["right"])
        ).alias("compatible"),
        F.transform(same_roles, lambda r: _role(r["role"], r["canonical"], r["predicate"], r["predicate"])).alias("exact_roles"),
    )

    def related(m: Column) -> Column:
        def judged(supported: Column) -> Column:
            relation = (
                F.when((F.size(m["exact"]) > 0) & (F.size(m["exact_roles"]) > 0), "exact")
                .when(F.size(supported) > 0, "transition")
                .otherwise("none")
            )
            return rules.once(relation, lambda r: described(r, supported))

        def described(relation: Column, supported: Column) -> Column:
            pair = lambda ts: F.transform(ts, lambda t: F.array(t["left"], t["right"]))
            return F.struct(
                relation.alias("action_relation"),
                m["exact"].alias("exact_predicates"),
                pair(m["compatible"]).alias("compatible_transitions"),
                pair(supported).alias("supported_transitions"),
                m["shared"].alias("shared_informative_concepts"),
                F.when(relation == "exact", m["exact_roles"])
                .when(relation == "transition", F.array_sort(F.array_distinct(F.flatten(F.transform(supported, moved)))))
                .otherwise(F.filter(m["exact_roles"], lambda _: F.lit(False)))
                .alias("shared_action_roles"),
                jaccard(first["informative"], second["informative"]).alias("informative_entity"),
                jaccard(first["concepts"], second["concepts"]).alias("all_entity"),
            )

        return rules.once(F.filter(m["compatible"], lambda t: F.arrays_overlap(t["support"], m["shared"])), judged)

    return rules.once(met, related)


def action_part(detail: Column) -> Column:
    relation = detail["action_relation"]
    return F.when(relation == "exact", 1.0).when(relation == "transition", 0.8).otherwise(0.0)


def role_part(detail: Column) -> Column:
    return F.least(F.size(detail["shared_action_roles"]) / F.lit(2.0), F.lit(1.0))


def continuity_score(detail: Column) -> Column:
    return (
        F.lit(0.5) * action_part(detail)
        + F.lit(0.3) * detail["informative_entity"]
        + F.lit(0.1) * detail["all_entity"]
        + F.lit(0.1) * role_part(detail)
    )


def has_continuity(detail: Column) -> Column:
    return (F.size(detail["shared_informative_concepts"]) > 0) & (detail["action_relation"] != "none")


SIGNATURE = ["clip_id", "clip_index", "start_seconds", "end_seconds", "concepts", "predicates", "informative", "roles"]


def assign_events(
    clips: DataFrame,
    threshold: float = 0.45,
    max_merged_clips: int = 5,
    max_gap_seconds: float = 1.0,
    extra: Sequence[str] = (),
    range_width: int = RANGE_WIDTH,
) -> DataFrame:
    """Give every clip its event: (event_index, event_position, joined, previous, detail, score).

    A clip joins the event of its predecessor if the gap is small, the continuity score reaches the
    threshold, they share an informative concept and a related action, and the event is not full.
    ``extra`` columns travel in ``previous`` too.
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be between 0 and 1")
    if max_merged_clips < 1:
        raise ValueError("max_merged_clips must be at least 1")

    def link(previous: Column, current: Column) -> Column:
        # The one-element array computes the detail once for all three tests.
        def test(detail: Column) -> Column:
            return (continuity_score(detail) >= threshold) & has_continuity(detail)

        near = (current["start_seconds"] - previous["end_seconds"]) <= max_gap_seconds
        return near & F.exists(F.array(continuity(previous, current)), test)

    runs = capped_runs(
        clips, "video_id", "clip_index", "clip_id", [*SIGNATURE, *extra], link, max_merged_clips, range_width
    )
    runs = runs.withColumnsRenamed({"run_index": "event_index", "run_position": "event_position"})
    runs = runs.withColumn("event_id", event_id(F.col("video_id"), F.col("event_index")))
    current = F.struct(*SIGNATURE)
    detail = F.when(F.col("previous").isNotNull(), continuity(F.col("previous"), current))
    runs = runs.withColumn("detail", detail)
    return runs.withColumn("score", F.when(F.col("detail").isNotNull(), continuity_score(F.col("detail"))))


def event_id(video_id: Column, index: Column) -> Column:
    return F.format_string("event:%s:%05d", video_id.cast("string"), index)


def build_events(assigned: DataFrame, max_representative_clips: int = 3) -> DataFrame:
    """One row per event. Its clips are one array; an event never has more clips than the merge cap."""
    if max_representative_clips < 1:
        raise ValueError("max_representative_clips must be at least 1")
    detail = F.col("detail")
    rows = assigned.withColumn("_score4", exact_round("score", 4))
    for name, value in (
        ("action", action_part(detail)),
        ("informative_entity", detail["informative_entity"]),
        ("all_entity", detail["all_entity"]),
        ("role", role_part(detail)),
    ):
        rows = rows.withColumn(f"_{name}", exact_round(value, 4))
    merge = F.when(
        F.col("joined"),
        F.struct(
            F.col("previous.clip_id").alias("from_clip_id"),
            F.col("clip_id").alias("to_clip_id"),
            F.col("_score4").alias("score"),
            *[detail[f].alias(f) for f in DETAIL_FIELDS],
            *[F.col(f"_{n}").alias(n) for n in ("action", "informative_entity", "all_entity", "role")],
        ),
    )
    wide = [c for c in ("tokens", "attribute_values") if c in assigned.columns]
    member = F.struct(
        *["clip_index", "clip_id", "start_seconds", "end_seconds", "concepts", "predicates", "informative"],
        *["observation_specificity", "argument_specificity"],
        *wide,
        merge.alias("merge"),
    )
    grouped = rows.groupBy("video_id", "event_index", "event_id").agg(F.array_sort(F.collect_list(member)).alias("clips"))
    merges = F.filter(F.transform("clips", lambda c: c["merge"]), lambda m: m.isNotNull())
    union = lambda field: F.array_sort(F.array_distinct(F.flatten(F.transform("clips", lambda c: c[field]))))
    events = grouped.select(
        "*",
        F.element_at("clips", 1)["start_seconds"].alias("start_seconds"),
        F.element_at("clips", -1)["end_seconds"].alias("end_seconds"),
        F.size("clips").alias("clip_count"),
        F.transform("clips", lambda c: c["clip_id"]).alias("supporting_clip_ids"),
        union("concepts").alias("concepts"),
        union("predicates").alias("predicates"),
        *[union(c).alias(c) for c in wide],
        merges.alias("merge_details"),
    )
    events = events.withColumn("merge_scores", F.transform("merge_details", lambda m: m["score"]))
    events = _with_support(events)
    events = _with_representatives(events, max_representative_clips)
    events = events.withColumn("label", event_label(F.col("predicates"), F.col("concepts")))
    if "tokens" in wide:
        events = events.withColumn("tokens", F.array_union("tokens", text.lexical_tokens(F.col("label"))))
    return events.drop("clips")


def event_label(predicates: Column, concepts: Column) -> Column:
    def head(values: Column, n: int, empty: str) -> Column:
        return F.when(F.size(values) == 0, F.lit(empty)).otherwise(F.array_join(F.slice(values, 1, n), ", "))

    return F.concat(
        head(predicates, 3, "no_normalized_action"), F.lit(" | "), head(concepts, 4, "no_normalized_concept")
    )


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def _with_support(events: DataFrame) -> DataFrame:
    """Structural support: clip specificity alone for single clips, mostly merge quality otherwise."""
    single = F.col("clip_count") == 1
    of_merges = lambda field: F.when(~single, _mean(F.transform("merge_details", lambda m: m[field])))
    parts = events.select(
        "*",
        _mean(F.transform("clips", lambda c: c["observation_specificity"])).alias("_observation"),
        _mean(F.transform("clips", lambda c: c["argument_specificity"])).alias("_argument"),
        of_merges("score").alias("_mean_score"),
        F.array_min("merge_scores").alias("_min_score"),
        of_merges("informative_entity").alias("_entity"),
        of_merges("role").alias("_role"),
    )
    parts = parts.withColumn(
        "_support",
        F.when(single, F.lit(0.6) * F.col("_observation") + F.lit(0.4) * F.col("_argument")).otherwise(
            F.lit(0.3) * F.col("_mean_score")
            + F.lit(0.15) * F.col("_min_score")
            + F.lit(0.2) * F.col("_entity")
            + F.lit(0.15) * F.col("_role")
            + F.lit(0.1) * F.col("_observation")
            + F.lit(0.1) * F.col("_argument")
        ),
    )
    components = F.struct(
        exact_round("_mean_score", 4).alias("mean_transition_score"),
        exact_round("_min_score", 4).alias("minimum_transition_score"),
        exact_round("_entity", 4).alias("entity_continuity"),
        exact_round("_role", 4).alias("role_consistency"),
        exact_round("_observation", 4).alias("observation_specificity"),
        exact_round("_argument", 4).alias("action_argument_specificity"),
    )
    return parts.select(
        *events.columns,
        exact_round("_support", 4).alias("structural_support_score"),
        F.when(single, "singleton_evidence").otherwise("merged_event").alias("support_mode"),
        components.alias("support_components"),
    )


def _with_representatives(events: DataFrame, budget: int) -> DataFrame:
    """Greedy choice of up to ``budget`` clips per event.

    Order of picks: best clip overall, best clip with a terminal action, best clip of an action
    sequence, then best remaining gain. The gain counts terms not covered yet, weighted by how few
    clips of the event have them. Every round is a projection over the clip array of the event.
    """
    ends_with = ", ".join(f"'{a}'" for a in vocab.TERMINAL_ACTIONS)
    terminal = rules.strings(vocab.TERMINAL_ACTIONS)

    def weighted(terms: str, field: str) -> str:
        per_term = f"size(filter(clips, c -> array_contains(c.{field}, t)))"
        return f"transform({terms}, t -> struct(t AS term, 1D / {per_term} AS w))"

    def summed(pairs: str) -> str:
        return f"aggregate({pairs}, 0D, (acc, p) -> acc + p.w)"

    moves = "filter(merge_details, m -> m.action_relation = 'transition')"
    df = events.withColumns(
        {
            "_moving": F.expr(f"array_distinct(flatten(transform({moves}, m -> array(m.from_clip_id, m.to_clip_id))))"),
            "_terms": F.expr("array_distinct(flatten(transform(clips, c -> c.informative)))"),
        }
    )
    df = df.withColumns({"_aw": F.expr(weighted("predicates", "predicates")), "_cw": F.expr(weighted("_terms", "informative"))})

    def gain(pairs: str, field: str, done: str) -> str:
        fresh = f"filter({pairs}, p -> array_contains(c.{field}, p.term) AND NOT array_contains({done}, p.term))"
        return f"coalesce(try_divide({summed(fresh)}, nullif({summed(pairs)}, 0D)), 0D)"

    utility = (
        f"0.55D * {gain('_aw', 'predicates', 's.did')} + 0.25D * {gain('_cw', 'informative', 's.dic')} "
        "+ 0.2D * (0.6D * c.observation_specificity + 0.4D * c.argument_specificity)"
    )
    stages = [
        "'primary_event_coverage'",
        "'terminal_action_coverage'",
        "'action_transition_coverage'",
        *["'marginal_event_coverage'"] * (budget - 1),
    ]
    allowed = (
        f"CASE g WHEN 'terminal_action_coverage' THEN arrays_overlap(c.predicates, array({ends_with})) "
        "WHEN 'action_transition_coverage' THEN array_contains(_moving, c.clip_id) ELSE true END"
    )
    # The rounds are one fold over the stages: the state holds the picks and what they cover. The
    # one-element arrays name the best clip once per round.
    free = f"filter(clips, c -> {allowed} AND NOT exists(s.picked, q -> q.clip_index = c.clip_index))"
    rated = f"transform({free}, c -> struct({utility} AS u, -CAST(c.clip_index AS BIGINT) AS i))"
    best = f"CASE WHEN size(s.picked) < least({budget}, clip_count) THEN array_max({rated}) END"
    pick = "struct(-b.i AS clip_index, b.u AS score, g AS reason)"
    own = "element_at(filter(clips, c -> c.clip_index = -b.i), 1)"
    after = (
        f"struct(array_append(s.picked, {pick}) AS picked, array_union(s.did, {own}.predicates) AS did, "
        f"array_union(s.dic, {own}.informative) AS dic)"
    )
    state = "struct<picked:array<struct<clip_index:bigint,score:double,reason:string>>,did:array<string>,dic:array<string>>"
    step = f"element_at(transform(array({best}), b -> CASE WHEN b IS NULL THEN s ELSE CAST({after} AS {state}) END), 1)"
    start = f"CAST(named_struct('picked', array(), 'did', array(), 'dic', array()) AS {state})"
    df = df.withColumn("_fold", F.expr(f"aggregate(array({', '.join(stages)}), {start}, (s, g) -> {step})"))
    df = df.withColumns({"_picked": F.col("_fold.picked"), "_did": F.col("_fold.did"), "_dic": F.col("_fold.dic")})

    def describe(p: Column, i: Column) -> Column:
        clip = F.element_at(F.filter("clips", lambda c: c["clip_index"].cast("bigint") == p["clip_index"]), 1)
        ends, shifts = F.arrays_overlap(clip["predicates"], terminal), F.array_contains(F.col("_moving"), clip["clip_id"])
        also = F.array(
            F.when(ends & (p["reason"] != "terminal_action_coverage"), "covers_terminal_action"),
            F.when(shifts & (p["reason"] != "action_transition_coverage"), "covers_action_transition"),
        )
        return F.struct(
            clip["clip_id"].alias("clip_id"),
            clip["clip_index"].alias("clip_index"),
            clip["start_seconds"].alias("start_seconds"),
            clip["end_seconds"].alias("end_seconds"),
            F.when(i == 0, "primary").when(ends, "terminal").when(shifts, "transition").otherwise("supporting").alias("role"),
            exact_round(p["score"], 4).alias("selection_score"),
            F.array_sort(clip["predicates"]).alias("covered_actions"),
            F.array_sort(clip["informative"]).alias("covered_informative_concepts"),
            F.concat(F.array(p["reason"]), F.filter(also, lambda r: r.isNotNull())).alias("reasons"),
        )

    df = df.withColumn("_acov", ratio(F.size("_did"), F.size("predicates"), 1.0)).withColumn(
        "_ccov", ratio(F.size("_dic"), F.size("_terms"), 1.0)
    )
    return df.select(
        *events.columns,
        F.transform("_picked", describe).alias("representatives"),
        exact_round("_acov", 4).alias("representative_action_coverage"),
        exact_round("_ccov", 4).alias("representative_entity_coverage"),
    )
