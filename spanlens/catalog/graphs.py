"""Normalised clips, events, graph tables and graph questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlens.catalog import query
from spanlens.catalog.inputs import CLIPS_SQL, clip_descriptions, table
from spanlens.functions import rules, text, vocab
from spanlens.operators import checks, events, graph, graphquery, normalize
from spanlens.plans.ordered import with_previous
from spanlens.session import cut_lineage

_BLOOD = r"\bblood\b(?!\s+vessels?\b)|"


def _matches(x: str, pattern: str) -> str:
    if pattern.startswith(_BLOOD):  # RE2 has no look-ahead
        rest = pattern[len(_BLOOD):]
        return f"(regexp_matches(regexp_replace({x}, '\\bblood\\s+vessels?\\b', '', 'g'), '\\bblood\\b') OR regexp_matches({x}, '{rest}'))"
    return f"regexp_matches({x}, '{pattern}')"


def entity_sql(x: str, hint: str) -> tuple[str, str]:
    """CASE chains for canonical and category."""
    canonical, category = ["CASE"], ["CASE"]
    for pattern, name, kind in vocab.ENTITY_RULES:
        canonical.append(f"WHEN {_matches(x, pattern)} THEN '{name}'")
        category.append(f"WHEN {_matches(x, pattern)} THEN '{kind}'")
    for pattern, name, kind, hinted in vocab.ENTITY_FALLBACKS:
        canonical.append(f"WHEN {_matches(x, pattern)} THEN '{name}'")
        category.append(f"WHEN {_matches(x, pattern)} THEN " + (f"coalesce({hint}, '{kind}')" if hinted else f"'{kind}'"))
    for kind, name in vocab.HINT_FALLBACKS:
        canonical.append(f"WHEN {hint} = '{kind}' THEN '{name}'")
        category.append(f"WHEN {hint} = '{kind}' THEN '{kind}'")
    return " ".join([*canonical, "ELSE 'generic_object' END"]), " ".join([*category, f"ELSE coalesce({hint}, 'object') END"])


def predicates_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN {v!r}" for p, v in vocab.ACTION_RULES) + " ELSE ['other_action'] END"


def attributes_sql(x: str) -> str:
    """All attribute values as 'group:value', sorted."""
    hits = ", ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{g}:{v}' END" for g, rs in vocab.ATTRIBUTE_RULES.items() for p, v in rs)
    return f"list_sort(list_distinct(list_filter([{hits}], lambda h: h IS NOT NULL)))"


_CAN, _CAT = entity_sql("s", "hint")
_PART = "SELECT p_partkey, p_name || CASE p_partkey % 7 " + " ".join(
    f"WHEN {i} THEN ' {w}'" for i, w in enumerate(["with blood", "blood vessel", "tool", "of tissue layers", "thread-like material", "device wall"])
) + " ELSE '' END AS surface, CASE p_partkey % 3 WHEN 0 THEN 'instrument' WHEN 1 THEN 'anatomy' END AS hint FROM part"
_CLEAN = "trim(regexp_replace(lower(surface), '\\s+', ' ', 'g'))"


@query(
    "entity_normalization",
    f"SELECT p_partkey, {_CAN} AS canonical, {_CAT} AS category, array_to_string({attributes_sql('s')}, ',') AS attributes FROM (SELECT *, {_CLEAN} AS s FROM ({_PART}))",
)
def entity_normalization(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' with blood' WHEN 1 THEN ' blood vessel' WHEN 2 THEN ' tool' WHEN 3 THEN ' of tissue layers' "
        "WHEN 4 THEN ' thread-like material' WHEN 5 THEN ' device wall' ELSE '' END) AS surface",
        "CASE p_partkey % 3 WHEN 0 THEN 'instrument' WHEN 1 THEN 'anatomy' END AS hint",
    )
    p = p.withColumn("s", rules.squeeze(F.col("surface")))
    pairs = F.flatten(F.transform(F.map_entries(rules.attributes(F.col("s"))), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v))))
    e = rules.entity(F.col("s"), F.col("hint"))
    return p.select("p_partkey", e["canonical"].alias("canonical"), e["category"].alias("category"), F.array_join(F.array_sort(pairs), ",").alias("attributes"))


_PHRASE = "CASE event_id % 9 " + " ".join(
    f"WHEN {i} THEN '{w}'"
    for i, w in enumerate(["Grasps  and pulls", "is looped and tightened", "pushes the thread through tissue", "Emits red light and contacts", "held taut", "applies pressure", "places on", "cuts"])
) + " ELSE event_type END"


@query("action_normalization", f"SELECT event_id, array_to_string({predicates_sql('s')}, ',') AS predicates FROM (SELECT event_id, trim(regexp_replace(lower({_PHRASE}), '\\s+', ' ', 'g')) AS s FROM events)")
def action_normalization(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("s", rules.squeeze(F.expr(_PHRASE)))
    return e.select("event_id", F.array_join(rules.predicates(F.col("s")), ",").alias("predicates"))


@query(
    "lexical_tokens",
    "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]+'), lambda t: len(t) > 1 AND NOT list_contains("
    + repr(vocab.STOPWORDS)
    + ", t)))), ' ') AS tokens FROM conversations",
)
def lexical_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(text.lexical_tokens(F.col("text"))), " ").alias("tokens"))


@query(
    "phrase_containment",
    "SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])') AS has_the, regexp_matches(lower(text), '(^|[^a-z0-9])and\\.($|[^a-z0-9])') AS has_and FROM documents",
)
def phrase_containment(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("_t", F.lower("text"))
    return d.select("doc_id", text.contains_phrase(F.col("_t"), "the").alias("has_the"), text.contains_phrase(F.col("_t"), "and.").alias("has_and"))


# Mentions and actions in plain relational form.
_SURFACES = f"""SELECT *, {_CAN} AS canonical, {_CAT} AS category FROM (
  SELECT *, surface AS s FROM (
  SELECT clip_id, video_id, clip_index, 0 AS seq, 'visible_anatomy' AS source_field, 'anatomy' AS hint, anatomy AS surface, false AS arg FROM c
  UNION ALL SELECT clip_id, video_id, clip_index, 1, 'visible_anatomy', 'anatomy', 'smooth tissue', false FROM c
  UNION ALL SELECT clip_id, video_id, clip_index, 2, 'visible_instruments', 'instrument', tool, false FROM c
  UNION ALL SELECT clip_id, video_id, clip_index, 3, 'visible_objects', 'object', object, false FROM c WHERE object IS NOT NULL
  UNION ALL SELECT clip_id, video_id, clip_index, 10, 'action_subject', NULL, subject, true FROM c
  UNION ALL SELECT clip_id, video_id, clip_index, 11, 'action_target', NULL, target, true FROM c))"""
_GRAPH_CTE = f"""WITH c AS MATERIALIZED ({CLIPS_SQL}), s AS MATERIALIZED ({_SURFACES}),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY seq) - 1 AS position FROM (
  SELECT * FROM s WHERE NOT arg UNION ALL
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, category, canonical ORDER BY seq) AS rn FROM s WHERE arg
    AND NOT EXISTS (SELECT 1 FROM s v WHERE v.clip_id = s.clip_id AND NOT v.arg AND v.category = s.category AND v.canonical = s.canonical)) WHERE rn = 1)),
mm AS MATERIALIZED (SELECT *, 'mention:' || clip_id || ':' || lpad(CAST(position AS VARCHAR), 3, '0') AS mention_id FROM m),
k AS MATERIALIZED (SELECT clip_id, category, canonical, arg_min(mention_id, position) AS mention_id FROM mm GROUP BY 1, 2, 3),
a AS MATERIALIZED (SELECT c.clip_id, c.video_id, c.clip_index, j, p[j + 1] AS predicate, 'action:' || c.clip_id || ':000:' || lpad(CAST(j AS VARCHAR), 2, '0') AS action_id, c.action AS original_action,
  ks.mention_id AS subject_mention_id, kt.mention_id AS target_mention_id, ks.canonical AS subject_canonical, kt.canonical AS target_canonical
  FROM (SELECT *, unnest(generate_series(0, len(p) - 1)) AS j FROM (SELECT *, {predicates_sql('action')} AS p FROM c)) c
  JOIN s ss ON ss.clip_id = c.clip_id AND ss.seq = 10 JOIN k ks ON ks.clip_id = c.clip_id AND ks.category = ss.category AND ks.canonical = ss.canonical
  JOIN s st ON st.clip_id = c.clip_id AND st.seq = 11 JOIN k kt ON kt.clip_id = c.clip_id AND kt.category = st.category AND kt.canonical = st.canonical)"""


def _normalized(spark, sf_dir):
    return normalize.normalize_clips(clip_descriptions(spark, sf_dir))


@query("clip_mentions", f"{_GRAPH_CTE} SELECT clip_id, mention_id, surface, canonical, category, source_field, array_to_string({attributes_sql('surface')}, ',') AS attributes FROM mm")
def clip_mentions(spark, sf_dir):
    rows = normalize.mention_rows(_normalized(spark, sf_dir))
    pairs = F.flatten(F.transform(F.map_entries("attributes"), lambda e: F.transform(e["value"], lambda v: F.concat(e["key"], F.lit(":"), v))))
    return rows.select("clip_id", "mention_id", "surface", "canonical", "category", "source_field", F.array_join(F.array_sort(pairs), ",").alias("attributes"))


@query("clip_actions", f"{_GRAPH_CTE} SELECT clip_id, action_id, predicate, original_action, subject_mention_id, target_mention_id FROM a")
def clip_actions(spark, sf_dir):
    rows = normalize.action_rows(_normalized(spark, sf_dir))
    return rows.select("clip_id", "action_id", "predicate", "original_action", "subject_mention_id", "target_mention_id")


@query(
    "observation_records",
    f"{_GRAPH_CTE} SELECT clip_id, summary, (SELECT count(*) FROM mm WHERE mm.clip_id = c.clip_id) AS mentions, (SELECT count(*) FROM a WHERE a.clip_id = c.clip_id) AS actions, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS excluded_inferences FROM c",
)
def observation_records(spark, sf_dir):
    out = normalize.observation_records(_normalized(spark, sf_dir))
    return out.select(
        "clip_id", "summary", F.size("mentions").alias("mentions"), F.size("actions").alias("actions"),
        F.size("medical_inferences_excluded_from_graph").alias("excluded_inferences"),
    )


_STOP = repr(vocab.STOP_CONCEPTS)
_TRANS = ", ".join(f"{{'l': '{a}', 'r': '{b}', 's': {s!r}}}" for (a, b), s in sorted(vocab.TRANSITION_SUPPORT.items()))
_EVENT_CTE = f"""{_GRAPH_CTE}, g AS MATERIALIZED (SELECT c.*, mc.concepts, list_filter(mc.concepts, lambda x: NOT list_contains({_STOP}, x)) AS informative, ac.predicates, coalesce(ac.roles, []) AS roles,
  0.7::DOUBLE * mc.good / mc.n + 0.3::DOUBLE * ac.known / ac.n AS obs, ac.args / (2.0::DOUBLE * ac.n) AS arg FROM c
  JOIN (SELECT clip_id, list_sort(list(DISTINCT canonical)) AS concepts, count(*) AS n, count(*) FILTER (NOT list_contains({_STOP}, canonical)) AS good FROM mm GROUP BY 1) mc USING (clip_id)
  JOIN (SELECT clip_id, list_sort(list(DISTINCT predicate)) AS predicates, count(*) AS n, count(*) FILTER (predicate <> 'other_action') AS known,
    sum(CAST(NOT list_contains({_STOP}, subject_canonical) AS INT) + CAST(NOT list_contains({_STOP}, target_canonical) AS INT)) AS args,
    list_distinct(list_concat(list('subject|' || subject_canonical || '|' || predicate) FILTER (NOT list_contains({_STOP}, subject_canonical)),
      list('target|' || target_canonical || '|' || predicate) FILTER (NOT list_contains({_STOP}, target_canonical)))) AS roles FROM a GROUP BY 1) ac USING (clip_id)),
p AS (SELECT n.clip_id, n.video_id, n.clip_index, n.start_seconds, n.end_seconds, n.obs, n.arg, n.concepts, n.predicates, n.informative, n.summary, v.clip_id AS prev_id, v.end_seconds AS prev_end, v.concepts AS vc, v.informative AS vi, v.predicates AS vp, v.roles AS vr, n.roles AS nr,
  list_intersect(v.informative, n.informative) AS shared,
  list_filter(list_filter([{_TRANS}], lambda t: list_contains(v.predicates, t.l) AND list_contains(n.predicates, t.r)), lambda t: len(list_intersect(t.s, list_intersect(v.informative, n.informative))) > 0) AS sup
  FROM g n LEFT JOIN g v ON v.video_id = n.video_id AND v.clip_index = n.clip_index - 1),
q AS (SELECT *, len(list_intersect(vp, predicates)) > 0 AND len(list_intersect(vr, nr)) > 0 AS exact FROM p),
r AS (SELECT *, CASE WHEN exact THEN 'exact' WHEN len(sup) > 0 THEN 'transition' ELSE 'none' END AS rel,
  CASE WHEN exact THEN len(list_intersect(vr, nr)) WHEN len(sup) > 0 THEN
    len(list_distinct(flatten(list_transform(sup, lambda t: list_transform(list_filter(vr, lambda x: ends_with(x, '|' || t.l) AND list_contains(nr, regexp_replace(x, '[^|]*$', '') || t.r)), lambda x: x || '>' || t.r))))) ELSE 0 END AS roles_n,
  CASE WHEN len(list_distinct(list_concat(vi, informative))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(vi, informative)) / CAST(len(list_distinct(list_concat(vi, informative))) AS DOUBLE) END AS ji,
  len(list_intersect(vc, concepts)) / CAST(len(list_distinct(list_concat(vc, concepts))) AS DOUBLE) AS jc FROM q),
t AS (SELECT *, CASE rel WHEN 'exact' THEN 1.0::DOUBLE WHEN 'transition' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS act, least(roles_n / 2.0::DOUBLE, 1.0) AS rp FROM r),
u AS (SELECT *, CASE WHEN prev_id IS NOT NULL THEN 0.5::DOUBLE * act + 0.3::DOUBLE * ji + 0.1::DOUBLE * jc + 0.1::DOUBLE * rp END AS score FROM t),
w AS (SELECT *, coalesce(start_seconds - prev_end <= 1.0 AND score >= 0.45 AND len(shared) > 0 AND rel <> 'none', false) AS link FROM u),
x AS (SELECT *, sum(CASE WHEN link THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY clip_index) AS island FROM w),
y AS (SELECT *, (row_number() OVER (PARTITION BY video_id, island ORDER BY clip_index) - 1) % 5 AS pos FROM x),
z AS MATERIALIZED (SELECT *, CAST(sum(CASE WHEN pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY clip_index) - 1 AS BIGINT) AS event_index FROM y),
e AS MATERIALIZED (SELECT video_id, event_index, 'event:' || video_id || ':' || lpad(CAST(event_index AS VARCHAR), 5, '0') AS event_id, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds, count(*) AS clip_count,
  list(clip_id ORDER BY clip_index) AS clips, list_sort(list_distinct(flatten(list(concepts)))) AS concepts, list_sort(list_distinct(flatten(list(predicates)))) AS predicates,
  CASE WHEN count(*) = 1 THEN 0.6 * avg(obs) + 0.4 * avg(arg) ELSE 0.3 * avg(CAST(printf('%.4f', score) AS DOUBLE)) FILTER (pos > 0) + 0.15 * min(CAST(printf('%.4f', score) AS DOUBLE)) FILTER (pos > 0)
    + 0.2 * avg(CAST(printf('%.4f', ji) AS DOUBLE)) FILTER (pos > 0) + 0.15 * avg(rp) FILTER (pos > 0) + 0.1 * avg(obs) + 0.1 * avg(arg) END AS support FROM z GROUP BY 1, 2)"""


def _signed(spark, sf_dir):
    # Written once: the event pass reads clips twice, and normalising them is the dear part.
    return cut_lineage(normalize.with_signature(_normalized(spark, sf_dir)))


# What events are made from, and what questions look for in them.
_EVENT_COLUMNS = ["video_id", *events.SIGNATURE, "observation_specificity", "argument_specificity"]
_ASKED_COLUMNS = ["tokens", "attribute_values"]


def _assigned(spark, sf_dir, *more):
    return events.assign_events(_signed(spark, sf_dir).select(*_EVENT_COLUMNS, *more))


def _linked(signed):
    """Clips with their event, and of their own and their neighbour's mentions what edges name. Texts of clips stay where they are."""
    named = F.transform("mentions", lambda m: F.struct(*[m[c].alias(c) for c in ("mention_id", "position", "canonical", "category")]))
    return events.assign_events(signed.select(*_EVENT_COLUMNS, named.alias("mentions"), "actions"), extra=["mentions", "actions"])


def _events(spark, sf_dir, *more):
    return events.build_events(_assigned(spark, sf_dir, *more))


@query("clip_neighbours", f"SELECT clip_id, lag(clip_id) OVER (PARTITION BY video_id ORDER BY clip_index) AS previous_clip FROM ({CLIPS_SQL})")
def clip_neighbours(spark, sf_dir):
    out = with_previous(clip_descriptions(spark, sf_dir), "video_id", "clip_index", "clip_id", ["clip_id"], width=16)
    return out.select("clip_id", F.col("previous.clip_id").alias("previous_clip"))


@query(
    "clip_continuity",
    f"{_EVENT_CTE} SELECT clip_id, rel AS action_relation, len(shared) AS shared_concepts, CAST(roles_n AS INT) AS shared_roles, round(score, 9) AS score FROM w WHERE prev_id IS NOT NULL",
)
def clip_continuity(spark, sf_dir):
    out = _assigned(spark, sf_dir).filter(F.col("detail").isNotNull())
    return out.select(
        "clip_id", F.col("detail.action_relation").alias("action_relation"), F.size("detail.shared_informative_concepts").alias("shared_concepts"),
        F.size("detail.shared_action_roles").alias("shared_roles"), F.round("score", 9).alias("score"),
    )


@query("clip_events", f"{_EVENT_CTE} SELECT clip_id, event_index, CAST(pos AS INT) AS event_position FROM z")
def clip_events(spark, sf_dir):
    return _assigned(spark, sf_dir).select("clip_id", "event_index", "event_position")


@query(
    "temporal_events",
    f"{_EVENT_CTE} SELECT event_id, start_seconds, end_seconds, clip_count, array_to_string(clips, ',') AS clips, array_to_string(concepts, ',') AS concepts, array_to_string(predicates, ',') AS predicates, CAST(printf('%.4f', support) AS DOUBLE) AS support FROM e",
)
def temporal_events(spark, sf_dir):
    out = _events(spark, sf_dir)
    return out.select(
        "event_id", "start_seconds", "end_seconds", "clip_count", F.array_join("supporting_clip_ids", ",").alias("clips"),
        F.array_join("concepts", ",").alias("concepts"), F.array_join("predicates", ",").alias("predicates"), F.col("structural_support_score").alias("support"),
    )


def _pick_steps(budget: int = 3) -> str:
    """One CTE per round of the greedy choice: the state of each event after the round."""
    conditions = ["true", "terminal", "moving", *["true"] * (budget - 1)]
    reasons = ["primary_event_coverage", "terminal_action_coverage", "action_transition_coverage", *["marginal_event_coverage"] * (budget - 1)]
    out = "k0 AS (SELECT video_id, event_index, n, CAST([] AS VARCHAR[]) AS did, CAST([] AS VARCHAR[]) AS dic, CAST([] AS STRUCT(i BIGINT, u DOUBLE, why VARCHAR)[]) AS picks FROM ew)"
    part = "coalesce(list_sum(list_transform(list_filter(c.{w}, lambda x: NOT list_contains(k.{d}, x.t)), lambda x: x.w)), 0) / c.{w}t"
    for i, (condition, why) in enumerate(zip(conditions, reasons)):
        worth = f"0.55 * CASE WHEN c.awt > 0 THEN {part.format(w='aw', d='did')} ELSE 0 END + 0.25 * CASE WHEN c.cwt > 0 THEN {part.format(w='cw', d='dic')} ELSE 0 END + 0.2 * c.spec"
        out += f""", b{i} AS (SELECT * FROM (SELECT k.video_id, k.event_index, c.clip_index AS i, c.predicates AS p, c.informative AS f, {worth} AS u FROM k{i} k JOIN ec c ON c.video_id = k.video_id AND c.event_index = k.event_index
    WHERE {condition} AND len(k.picks) < least({budget}, k.n) AND NOT list_contains(list_transform(k.picks, lambda x: x.i), c.clip_index)) QUALIFY row_number() OVER (PARTITION BY video_id, event_index ORDER BY round(u, 12) DESC, i) = 1),
k{i + 1} AS MATERIALIZED (SELECT k.video_id, k.event_index, k.n, CASE WHEN b.i IS NULL THEN did ELSE list_distinct(list_concat(did, b.p)) END AS did, CASE WHEN b.i IS NULL THEN dic ELSE list_distinct(list_concat(dic, b.f)) END AS dic,
    CASE WHEN b.i IS NULL THEN picks ELSE list_append(picks, {{'i': b.i, 'u': b.u, 'why': '{why}'}}) END AS picks FROM k{i} k LEFT JOIN b{i} b ON b.video_id = k.video_id AND b.event_index = k.event_index)"""
    return out + f", kk AS MATERIALIZED (SELECT * FROM k{len(conditions)})"


_REP_CTE = f"""{_EVENT_CTE}, mv AS (SELECT video_id, event_index, clip_id FROM z WHERE pos > 0 AND rel = 'transition' UNION SELECT video_id, event_index, prev_id FROM z WHERE pos > 0 AND rel = 'transition'),
wa AS (SELECT video_id, event_index, t, 1.0 / count(*) AS w FROM (SELECT video_id, event_index, unnest(predicates) AS t FROM z) GROUP BY ALL), wc AS (SELECT video_id, event_index, t, 1.0 / count(*) AS w FROM (SELECT video_id, event_index, unnest(informative) AS t FROM z) GROUP BY ALL),
ew AS MATERIALIZED (SELECT e.video_id, e.event_index, e.clip_count AS n, coalesce(x.l, []) AS aw, coalesce(y.l, []) AS cw, coalesce(x.s, 0) AS awt, coalesce(y.s, 0) AS cwt FROM e
  LEFT JOIN (SELECT video_id, event_index, list({{'t': t, 'w': w}} ORDER BY t) AS l, sum(w) AS s FROM wa GROUP BY 1, 2) x ON x.video_id = e.video_id AND x.event_index = e.event_index
  LEFT JOIN (SELECT video_id, event_index, list({{'t': t, 'w': w}} ORDER BY t) AS l, sum(w) AS s FROM wc GROUP BY 1, 2) y ON y.video_id = e.video_id AND y.event_index = e.event_index),
ec AS MATERIALIZED (SELECT z.video_id, z.event_index, z.clip_id, z.clip_index, z.start_seconds, z.end_seconds, z.predicates, z.informative, 0.6 * z.obs + 0.4 * z.arg AS spec, awt, cwt,
  list_filter(aw, lambda x: list_contains(z.predicates, x.t)) AS aw, list_filter(cw, lambda x: list_contains(z.informative, x.t)) AS cw, len(list_intersect(z.predicates, {vocab.TERMINAL_ACTIONS!r})) > 0 AS terminal, mv.clip_id IS NOT NULL AS moving
  FROM z JOIN ew ON ew.video_id = z.video_id AND ew.event_index = z.event_index LEFT JOIN mv ON mv.video_id = z.video_id AND mv.event_index = z.event_index AND mv.clip_id = z.clip_id),
{_pick_steps()},
rc AS MATERIALIZED (SELECT kk.video_id, kk.event_index, CAST(printf('%.4f', CASE WHEN len(e.predicates) = 0 THEN 1 ELSE len(did) / CAST(len(e.predicates) AS DOUBLE) END) AS DOUBLE) AS acov,
  CAST(printf('%.4f', CASE WHEN len(ew.cw) = 0 THEN 1 ELSE len(dic) / CAST(len(ew.cw) AS DOUBLE) END) AS DOUBLE) AS ccov, picks FROM kk JOIN e ON e.video_id = kk.video_id AND e.event_index = kk.event_index JOIN ew ON ew.video_id = kk.video_id AND ew.event_index = kk.event_index),
rp AS MATERIALIZED (SELECT e.video_id, e.event_index, e.event_id, x.j, c.clip_id, c.clip_index, c.start_seconds, c.end_seconds,
  CASE WHEN j = 1 THEN 'primary' WHEN c.terminal THEN 'terminal' WHEN c.moving THEN 'transition' ELSE 'supporting' END AS role, CAST(printf('%.4f', x.p.u) AS DOUBLE) AS selection_score, list_sort(c.predicates) AS covered_actions, list_sort(c.informative) AS covered_informative_concepts,
  list_filter([x.p.why, CASE WHEN c.terminal AND x.p.why <> 'terminal_action_coverage' THEN 'covers_terminal_action' END, CASE WHEN c.moving AND x.p.why <> 'action_transition_coverage' THEN 'covers_action_transition' END], lambda r: r IS NOT NULL) AS reasons
  FROM (SELECT video_id, event_index, unnest(picks) AS p, generate_subscripts(picks, 1) AS j FROM rc) x JOIN e ON e.video_id = x.video_id AND e.event_index = x.event_index JOIN ec c ON c.video_id = x.video_id AND c.event_index = x.event_index AND c.clip_index = x.p.i)"""


@query(
    "representative_clips",
    f"""{_REP_CTE} SELECT rp.event_id, rc.acov AS representative_action_coverage, rc.ccov AS representative_entity_coverage, clip_id, clip_index, start_seconds, end_seconds, role, selection_score,
        array_to_string(covered_actions, ',') AS covered_actions, array_to_string(covered_informative_concepts, ',') AS covered_informative_concepts, array_to_string(reasons, ',') AS reasons FROM rp JOIN rc ON rc.video_id = rp.video_id AND rc.event_index = rp.event_index""",
)
def representative_clips(spark, sf_dir):
    out = _events(spark, sf_dir)
    rows = out.select("event_id", "representative_action_coverage", "representative_entity_coverage", F.explode_outer("representatives").alias("r")).select(
        "event_id", "representative_action_coverage", "representative_entity_coverage", "r.*"
    )
    return rows.withColumns({c: F.array_join(c, ",") for c in ("covered_actions", "covered_informative_concepts", "reasons")})


_CONCEPT = "'concept:' || category || ':' || canonical"
_NODES = f"""SELECT video_id, 'clip:' || clip_id AS id, 'segment' AS node_type, summary AS label FROM c
  UNION ALL SELECT video_id, mention_id, 'entity_mention', surface FROM mm UNION ALL SELECT video_id, action_id, 'action_event', predicate FROM a
  UNION ALL SELECT DISTINCT video_id, {_CONCEPT}, 'concept', canonical FROM mm UNION ALL SELECT DISTINCT video_id, 'concept:action:' || predicate, 'concept', predicate FROM a
  UNION ALL SELECT video_id, event_id, 'temporal_event', coalesce(nullif(array_to_string(predicates[1:3], ', '), ''), 'no_normalized_action') || ' | ' || coalesce(nullif(array_to_string(concepts[1:4], ', '), ''), 'no_normalized_concept') FROM e"""


@query("graph_nodes", f"{_EVENT_CTE} SELECT * FROM ({_NODES})")
def graph_nodes(spark, sf_dir):
    signed = _signed(spark, sf_dir)
    nodes = graph.build_nodes(signed, events.build_events(events.assign_events(signed.select(*_EVENT_COLUMNS))))
    return nodes.select("video_id", "id", "node_type", "label")


@query(
    "graph_node_evidence",
    f"""{_EVENT_CTE} SELECT video_id, id, clip_id FROM (SELECT video_id, 'clip:' || clip_id AS id, clip_id FROM c UNION ALL SELECT video_id, mention_id, clip_id FROM mm UNION ALL SELECT video_id, action_id, clip_id FROM a
        UNION ALL SELECT DISTINCT video_id, {_CONCEPT}, clip_id FROM mm UNION ALL SELECT DISTINCT video_id, 'concept:action:' || predicate, clip_id FROM a
        UNION ALL SELECT z.video_id, e.event_id, z.clip_id FROM z JOIN e ON e.video_id = z.video_id AND e.event_index = z.event_index)""",
)
def graph_node_evidence(spark, sf_dir):
    return graph.build_node_evidence(_assigned(spark, sf_dir, "mentions", "actions")).select("video_id", "id", "clip_id")


_FIRST = f"SELECT mm.*, row_number() OVER (PARTITION BY clip_id, category, canonical ORDER BY position) AS rn FROM mm WHERE NOT list_contains({_STOP}, canonical)"
_EDGES = f"""SELECT video_id, mention_id AS source, 'clip:' || clip_id AS target, 'observed_in' AS relation, 1.0 AS confidence FROM mm
  UNION ALL SELECT video_id, mention_id, {_CONCEPT}, 'instance_of', 0.95 FROM mm UNION ALL SELECT video_id, action_id, 'clip:' || clip_id, 'observed_in', 1 FROM a
  UNION ALL SELECT video_id, action_id, 'concept:action:' || predicate, 'instance_of', 0.98 FROM a UNION ALL SELECT video_id, action_id, subject_mention_id, 'has_subject', 1 FROM a
  UNION ALL SELECT video_id, action_id, target_mention_id, 'acts_on', 1 FROM a
  UNION ALL SELECT a.video_id, action_id, e.event_id, 'part_of', 1 FROM a JOIN z ON z.clip_id = a.clip_id JOIN e ON e.video_id = z.video_id AND e.event_index = z.event_index
  UNION ALL SELECT z.video_id, e.event_id, 'clip:' || clip_id, 'contains', 1 FROM z JOIN e ON e.video_id = z.video_id AND e.event_index = z.event_index
  UNION ALL SELECT video_id, 'clip:' || prev_id, 'clip:' || clip_id, 'temporal_before', 1 FROM z WHERE prev_id IS NOT NULL
  UNION ALL SELECT l.video_id, l.event_id, n.event_id, 'temporal_before', 1 FROM e l JOIN e n ON n.video_id = l.video_id AND n.event_index = l.event_index + 1
  UNION ALL SELECT l.video_id, l.mention_id, n.mention_id, 'possible_continuation', 0.6 FROM ({_FIRST}) l JOIN ({_FIRST}) n ON n.video_id = l.video_id AND n.clip_index = l.clip_index + 1
    AND n.category = l.category AND n.canonical = l.canonical WHERE l.rn = 1 AND n.rn = 1
  UNION ALL SELECT l.video_id, l.action_id, min(n.action_id), 'possible_continuation', 0.65 FROM a l JOIN a n ON n.video_id = l.video_id AND n.clip_index = l.clip_index + 1 AND n.predicate = l.predicate
    AND n.subject_canonical = l.subject_canonical AND n.target_canonical = l.target_canonical GROUP BY 1, 2"""


@query("graph_edges", f"{_EVENT_CTE} SELECT video_id, source, target, relation, CAST(confidence AS DOUBLE) AS confidence FROM ({_EDGES})")
def graph_edges(spark, sf_dir):
    assigned = cut_lineage(_linked(_signed(spark, sf_dir)))
    return graph.build_edges(assigned, events.build_events(assigned)).select("video_id", "source", "target", "relation", "confidence")


@query(
    "graph_report",
    f"""{_EVENT_CTE}, nn AS MATERIALIZED ({_NODES}), ee AS MATERIALIZED ({_EDGES}) SELECT c.video_id, c.source_clip_count, c.medical_inference_item_count, ac.other_action_count, ev.*, nn.*, ee.* FROM
        (SELECT video_id, count(*) AS source_clip_count, count(*) FILTER (event_id % 3 = 0) AS medical_inference_item_count FROM c GROUP BY 1) c
        JOIN (SELECT video_id AS v1, count(*) FILTER (predicate = 'other_action') AS other_action_count FROM a GROUP BY 1) ac ON v1 = video_id
        JOIN (SELECT video_id AS v2, count(*) AS temporal_event_count, count(*) FILTER (clip_count > 1) AS merged_temporal_event_count, max(clip_count) AS maximum_clips_per_event FROM e GROUP BY 1) ev ON v2 = video_id
        JOIN (SELECT video_id AS v3, count(*) AS node_count, count(*) FILTER (node_type = 'concept') AS concepts FROM nn GROUP BY 1) nn ON v3 = video_id
        JOIN (SELECT video_id AS v4, count(*) AS edge_count, count(*) FILTER (relation = 'possible_continuation') AS continuations FROM ee GROUP BY 1) ee ON v4 = video_id""",
)
def graph_report(spark, sf_dir):
    signed = _signed(spark, sf_dir)
    assigned = cut_lineage(_linked(signed))
    built = cut_lineage(events.build_events(assigned))
    nodes, edges = graph.build_nodes(signed, built), graph.build_edges(assigned, built)
    out = graph.graph_report(nodes, edges, signed, built)
    v = F.col("video_id")
    return out.select(
        "video_id", "source_clip_count", "medical_inference_item_count", "other_action_count", v.alias("v2"), "temporal_event_count", "merged_temporal_event_count",
        F.col("maximum_clips_per_event").cast("bigint").alias("maximum_clips_per_event"), v.alias("v3"), "node_count", F.col("node_type_counts")["concept"].alias("concepts"),
        v.alias("v4"), "edge_count", F.coalesce(F.col("edge_type_counts")["possible_continuation"], F.lit(0)).alias("continuations"),
    )


@query("graph_violations", "SELECT 'x' AS check, 0 AS rows WHERE false")
def graph_violations(spark, sf_dir):
    """Rule checks on the graph built here; a valid graph gives no rows."""
    signed = _signed(spark, sf_dir)
    assigned = cut_lineage(_linked(signed))
    built = cut_lineage(events.build_events(assigned))
    nodes, edges = graph.build_nodes(signed, built), graph.build_edges(assigned, built)
    proof = graph.build_node_evidence(assigned)
    found = {
        "nodes": checks.node_violations(nodes),
        "grounding": checks.ungrounded_nodes(nodes, proof),
        "intervals": checks.interval_violations(proof),
        "edges": checks.edge_violations(edges),
        "node_ids": checks.duplicate_keys(nodes, ["video_id", "id"]),
        "edge_ends": checks.dangling_edges(edges, nodes),
        "chain": checks.branching_events(edges, built),
        "events": checks.graphs_without_events(nodes),
    }
    out = None
    for name, df in found.items():
        part = df.groupBy(F.lit(name).alias("check")).agg(F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "top_concepts",
    f"""{_GRAPH_CTE} SELECT video_id, term, n, rank FROM (SELECT video_id, canonical AS term, count(*) AS n, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, min(clip_index * 1000 + position)) AS rank FROM mm GROUP BY 1, 2) WHERE rank <= 20""",
)
def top_concepts(spark, sf_dir):
    return graph.top_terms(_normalized(spark, sf_dir), "concepts").select("video_id", "term", "n", "rank")


@query(
    "top_actions",
    f"""{_GRAPH_CTE} SELECT video_id, term, n, rank FROM (SELECT video_id, predicate AS term, count(*) AS n, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, min(clip_index * 1000 + j)) AS rank FROM a GROUP BY 1, 2) WHERE rank <= 20""",
)
def top_actions(spark, sf_dir):
    return graph.top_terms(_normalized(spark, sf_dir), "actions").select("video_id", "term", "n", "rank")


@query(
    "concept_table",
    f"""{_GRAPH_CTE} SELECT video_id, category, canonical, count(*) AS mention_count, count(DISTINCT clip_id) AS clip_count FROM
        (SELECT video_id, clip_id, category, canonical FROM mm UNION ALL SELECT video_id, clip_id, 'action', predicate FROM a) GROUP BY 1, 2, 3""",
)
def concept_table(spark, sf_dir):
    return graph.concept_table(_normalized(spark, sf_dir)).select("video_id", "category", "canonical", "mention_count", "clip_count")


# A quotient of whole ten-thousandths, rounded half to even.
_FOUR = "CAST((({top}) // ({down})) + CASE WHEN 2 * (({top}) % ({down})) > ({down}) OR (2 * (({top}) % ({down})) = ({down}) AND (({top}) // ({down})) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10000.0"


@query(
    "support_summary",
    f"{_EVENT_CTE} SELECT video_id, count(*) AS count, min(s) AS minimum, {_FOUR.format(top='sum(t)', down='count(*)')} AS mean, {_FOUR.format(top='CAST(median(t) * 2 AS BIGINT)', down='2')} AS median, max(s) AS maximum FROM (SELECT video_id, CAST(printf('%.4f', support) AS DOUBLE) AS s, CAST(round(CAST(printf('%.4f', support) AS DOUBLE) * 10000) AS BIGINT) AS t FROM e) GROUP BY 1",
)
def support_summary(spark, sf_dir):
    out = graph.score_summary(_events(spark, sf_dir), "structural_support_score")
    return out.select("video_id", "count", "minimum", "mean", "median", "maximum")


# One question per clip, about its own recording.
def _question(string: str) -> str:
    return (
        "CASE clip_index % 5 WHEN 0 THEN 'What happens after the ' || subject || ' ' || action || ' near ' || target || '?' "
        "WHEN 1 THEN 'Which ' || tool || ' is seen before tightening the blue suture?' WHEN 2 THEN 'How does traction act on ' || anatomy || ', then cutting?' "
        f"WHEN 3 THEN 'Frame number ' || CAST(clip_index + 7000 AS {string}) || ' calibrated zzz' ELSE 'Show ' || action || ' with the ' || coalesce(object, 'tubular structure') END"
    )


def graph_questions(spark, sf_dir):
    flat = clip_descriptions(spark, sf_dir)
    facts, acts = F.col("description.observed_facts"), F.col("description.observed_facts.actions")
    rows = flat.select(
        F.col("clip_id").alias("question_id"), "video_id", "clip_index", acts[0]["subject"].alias("subject"), acts[0]["action"].alias("action"),
        acts[0]["target"].alias("target"), facts["visible_instruments"][0].alias("tool"), facts["visible_anatomy"][0].alias("anatomy"),
        F.try_element_at(facts["visible_objects"], F.lit(1)).alias("object"),
    )
    # Written once, as questions are a table of their own elsewhere: the text is named many times below.
    return cut_lineage(rows.select("question_id", "video_id", F.expr(_question("STRING")).alias("question")))


def _phrase(x: str, phrase: str) -> str:
    return f"regexp_matches({x}, '(^|[^a-z0-9]){phrase}($|[^a-z0-9])')"


_SAID_ACTIONS = ", ".join(
    "CASE WHEN " + " OR ".join(_phrase("ql", w) for w in [p.replace("_", " "), *vocab.ACTION_ALIASES.get(p, [])]) + f" THEN '{p}' END" for p in vocab.ACTION_VOCABULARY
)
_SAID_CONCEPTS = ", ".join(f"CASE WHEN {_phrase('ql', c.replace('_', ' '))} THEN '{c}' END" for c in vocab.ENTITY_VOCABULARY)
_RULE_CANON = "CASE " + " ".join(f"WHEN {_matches('gram', p)} THEN '{c}'" for p, c, _ in vocab.ENTITY_RULES) + " END"
_QUERY_CTE = f"""{_EVENT_CTE}, q0 AS (SELECT clip_id AS question_id, video_id, {_question('VARCHAR')} AS question FROM c),
q1 AS MATERIALIZED (SELECT *, trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) AS ql FROM q0),
frag AS (SELECT question_id, ql AS f FROM q1 UNION ALL SELECT question_id, unnest(string_split(regexp_replace(ql, '[?.,;:]|\\b(?:after|before|then|while|followed by|and)\\b', chr(1), 'g'), chr(1))) FROM q1),
qa AS (SELECT question_id, unnest({predicates_sql("trim(regexp_replace(f, '\\s+', ' ', 'g'))")}) AS term FROM frag UNION SELECT question_id, unnest(list_filter([{_SAID_ACTIONS}], lambda x: x IS NOT NULL)) FROM q1),
wd AS MATERIALIZED (SELECT question_id, regexp_extract_all(ql, '[a-z0-9-]+') AS ws FROM q1),
gr AS (SELECT DISTINCT question_id, gram FROM (SELECT question_id, array_to_string(ws[i:i + n - 1], ' ') AS gram FROM (SELECT question_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM wd, (SELECT unnest([1, 2, 3, 4, 5]) AS n) WHERE len(ws) >= n))),
qc AS (SELECT question_id, {_RULE_CANON} AS term FROM gr UNION SELECT question_id, unnest(list_filter([{_SAID_CONCEPTS}], lambda x: x IS NOT NULL)) FROM q1),
et AS MATERIALIZED (SELECT video_id, event_index, 'a' AS kind, unnest(predicates) AS term FROM e UNION ALL SELECT video_id, event_index, 'c', unnest(concepts) FROM e),
df AS MATERIALIZED (SELECT video_id, kind, term, count(*) AS df FROM et GROUP BY 1, 2, 3), nv AS (SELECT video_id, count(*) AS n FROM e GROUP BY 1),
qt AS MATERIALIZED (SELECT q1.question_id, q1.video_id, df.kind, df.term, ln((nv.n + 1) / CAST(df.df + 1 AS DOUBLE)) + 1.0 AS w FROM
  (SELECT DISTINCT question_id, 'a' AS kind, term FROM qa WHERE term <> 'other_action' UNION SELECT DISTINCT question_id, 'c', term FROM qc WHERE term IS NOT NULL AND NOT list_contains({vocab.GENERIC_QUERY_CONCEPTS!r}, term)) t
  JOIN q1 USING (question_id) JOIN df ON df.video_id = q1.video_id AND df.kind = t.kind AND df.term = t.term JOIN nv ON nv.video_id = q1.video_id),
ql AS MATERIALIZED (SELECT question_id, video_id, {attributes_sql('ql')} AS attrs, list_distinct(list_filter(regexp_extract_all(ql, '[a-z0-9]+|[一-鿿]+'), lambda t: len(t) > 1 AND NOT list_contains({vocab.STOPWORDS!r}, t))) AS toks FROM q1)"""


@query(
    "normalized_questions",
    f"""{_QUERY_CTE} SELECT ql.question_id, coalesce(string_agg(term, ',' ORDER BY term) FILTER (kind = 'a'), '') AS predicates, coalesce(string_agg(term, ',' ORDER BY term) FILTER (kind = 'c'), '') AS concepts,
        round(coalesce(sum(w), 0), 6) AS weight, array_to_string(list_sort(list_distinct(list_transform(any_value(attrs), lambda x: regexp_replace(x, '^.*:', '')))), ',') AS attributes, array_to_string(list_sort(any_value(toks)), ',') AS tokens
        FROM ql LEFT JOIN qt USING (question_id) GROUP BY 1""",
)
def normalized_questions(spark, sf_dir):
    terms = graphquery.recording_terms(cut_lineage(_events(spark, sf_dir).select("video_id", "predicates", "concepts")))
    n = graphquery.normalize_questions(graph_questions(spark, sf_dir), terms)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    return n.select(
        "question_id", F.array_join("query_predicates", ",").alias("predicates"), F.array_join("query_concepts", ",").alias("concepts"),
        F.round(total("predicate_weights") + total("concept_weights"), 6).alias("weight"), F.array_join("query_attributes", ",").alias("attributes"),
        F.array_join("query_tokens", ",").alias("tokens"),
    )


def _lookup(spark, sf_dir):
    built = cut_lineage(_events(spark, sf_dir, *_ASKED_COLUMNS))
    questions = graph_questions(spark, sf_dir)
    return questions, built


@query(
    "unmatched_questions",
    f"""{_QUERY_CTE}, tok AS MATERIALIZED (SELECT video_id, unnest(regexp_extract_all(lower(summary || ' '), '[a-z0-9]+')) AS tk FROM c UNION SELECT video_id, unnest(regexp_extract_all(lower(label), '[a-z0-9]+')) FROM ({_NODES}) WHERE node_type = 'temporal_event'),
        att AS MATERIALIZED (SELECT DISTINCT video_id, unnest({attributes_sql('surface')}) AS av FROM mm)
        SELECT question_id, 'no_match' AS status FROM ql WHERE question_id NOT IN (SELECT question_id FROM qt)
        AND NOT EXISTS (SELECT 1 FROM tok WHERE tok.video_id = ql.video_id AND list_contains(ql.toks, tok.tk)) AND NOT EXISTS (SELECT 1 FROM att WHERE att.video_id = ql.video_id AND list_contains(ql.attrs, att.av))""",
)
def unmatched_questions(spark, sf_dir):
    questions, built = _lookup(spark, sf_dir)
    _, ranked = graphquery.retrieve_groups(questions, built)
    return graphquery.unmatched(questions, ranked).select("question_id", "status")


def _hop(i: int, terms: str = "terms", words: str = "words") -> str:
    """State of each seed after one more step along the edges."""
    context = f"coalesce({i == 0} AND s.relation IN ('after', 'before'), false)".replace("True", "true").replace("False", "false")
    fresh = "len(list_filter(n.{0}, lambda x: NOT list_contains(s.{0}, x)))"
    return f"""o{i} AS (SELECT * FROM (SELECT s.question_id, s.seed_rank, n.off, n.event_id, n.terms AS t, n.words AS w, {fresh.format('terms')} AS gain, {fresh.format('words')} AS more FROM s{i} s JOIN near n ON n.question_id = s.question_id AND n.seed_rank = s.seed_rank
    AND n.off IN (s.lo - 1, s.hi + 1) WHERE s.alive) QUALIFY row_number() OVER (PARTITION BY question_id, seed_rank ORDER BY gain DESC, more DESC, event_id, off) = 1),
s{i + 1} AS MATERIALIZED (SELECT s.question_id, s.seed_rank, s.relation, CASE WHEN go THEN least(lo, off) ELSE lo END AS lo, CASE WHEN go THEN greatest(hi, off) ELSE hi END AS hi, go AS alive,
    CASE WHEN go THEN list_concat(terms, t) ELSE terms END AS terms, CASE WHEN go THEN list_concat(words, w) ELSE words END AS words,
    CASE WHEN NOT go THEN reason WHEN {context} THEN 'query_' || relation || '_context' ELSE 'additional_query_term_coverage' END AS reason
    FROM (SELECT s.*, o.off, o.t, o.w, o.off IS NOT NULL AND (gain > 0 OR more > 0 OR {context}) AS go FROM s{i} s LEFT JOIN o{i} o ON o.question_id = s.question_id AND o.seed_rank = s.seed_rank) s)"""


def _scores(p: str, c: str, a: str, t: str) -> str:
    """Coverages, relevance and bonus of matched lists for the question ``x``."""
    weighed = "CASE WHEN len(x.{q}) = 0 THEN 0 ELSE list_sum(list_transform(list_filter(x.{q}, lambda v: list_contains({m}, v.t)), lambda v: v.w)) / list_sum(list_transform(x.{q}, lambda v: v.w)) END"
    counted = "CASE WHEN len(x.{q}) = 0 THEN 0 ELSE len({m}) / CAST(len(x.{q}) AS DOUBLE) END"
    return f"""coalesce({weighed.format(q='qp', m=p)}, 0) AS ac, coalesce({weighed.format(q='qc', m=c)}, 0) AS cc, {counted.format(q='qa', m=a)} AS tc, {counted.format(q='qw', m=t)} AS lc,
    CASE WHEN len({p}) > 0 AND len({c}) > 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END AS joint"""


_USED = "(CASE WHEN len(qp) > 0 THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN len(qc) > 0 THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN len(qa) > 0 THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN len(qw) > 0 THEN 0.1 ELSE 0 END::DOUBLE)"
_RELEVANCE = f"CASE WHEN {_USED} > 0 THEN (0.5 * ac + 0.35 * cc + 0.05 * tc + 0.1 * lc) / {_USED} ELSE 0 END"


def _six(x: str) -> str:
    return f"CAST(printf('%.6f', {x}) AS DOUBLE)"


def _group_cte(edges: str) -> str:
    """Ranked groups ``rk`` grown along ``edges`` (video_id, source, target, place), of which the last one of an event counts."""
    return f"""{_QUERY_CTE.replace("WITH c AS", "WITH RECURSIVE c AS", 1)}, {_REP_CTE[len(_EVENT_CTE) + 2:]},
lab AS (SELECT video_id, event_index, coalesce(nullif(array_to_string(predicates[1:3], ', '), ''), 'no_normalized_action') || ' | ' || coalesce(nullif(array_to_string(concepts[1:4], ', '), ''), 'no_normalized_concept') AS label FROM e),
tk AS (SELECT video_id, event_index, list_distinct(list(tk)) AS toks FROM (SELECT z.video_id, z.event_index, unnest(regexp_extract_all(lower(summary), '[a-z0-9]+|[一-鿿]+')) AS tk FROM z UNION ALL SELECT video_id, event_index, unnest(regexp_extract_all(lower(label), '[a-z0-9]+|[一-鿿]+')) FROM lab) WHERE len(tk) > 1 AND NOT list_contains({vocab.STOPWORDS!r}, tk) GROUP BY 1, 2),
av AS (SELECT z.video_id, z.event_index, list_distinct(list(regexp_replace(v, '^.*:', ''))) AS attrs FROM z JOIN (SELECT clip_id, unnest({attributes_sql('surface')}) AS v FROM mm) m USING (clip_id) GROUP BY 1, 2),
ev AS MATERIALIZED (SELECT e.video_id, e.event_index, e.event_id, e.start_seconds, e.end_seconds, e.predicates, e.concepts, coalesce(av.attrs, []) AS attrs, coalesce(tk.toks, []) AS toks, CAST(printf('%.4f', e.support) AS DOUBLE) AS support, rc.acov, rc.ccov
  FROM e JOIN rc ON rc.video_id = e.video_id AND rc.event_index = e.event_index LEFT JOIN tk ON tk.video_id = e.video_id AND tk.event_index = e.event_index LEFT JOIN av ON av.video_id = e.video_id AND av.event_index = e.event_index),
qq AS MATERIALIZED (SELECT ql.question_id, ql.video_id, coalesce(p.l, []) AS qp, coalesce(k.l, []) AS qc, list_sort(list_distinct(list_transform(attrs, lambda x: regexp_replace(x, '^.*:', '')))) AS qa, toks AS qw,
  CASE WHEN regexp_matches(ql, '\\b(after|following)\\b') THEN 'after' WHEN regexp_matches(ql, '\\b(before|prior to|preceding)\\b') THEN 'before' WHEN regexp_matches(ql, '\\b(then|followed by|sequence|order)\\b') THEN 'sequence' END AS relation
  FROM ql JOIN q1 USING (question_id) LEFT JOIN (SELECT question_id, list({{'t': term, 'w': w}} ORDER BY term) AS l FROM qt WHERE kind = 'a' GROUP BY 1) p USING (question_id) LEFT JOIN (SELECT question_id, list({{'t': term, 'w': w}} ORDER BY term) AS l FROM qt WHERE kind = 'c' GROUP BY 1) k USING (question_id)),
pr AS MATERIALIZED (SELECT *, {_six(_RELEVANCE)} AS relevance FROM (SELECT x.*, v.event_id, v.event_index, v.start_seconds, v.end_seconds, v.support, v.acov, v.ccov, mp, mc, ma, mt, {_scores('mp', 'mc', 'ma', 'mt')}
  FROM (SELECT q.*, v.event_id AS vid, list_filter(v.predicates, lambda t: list_contains(list_transform(q.qp, lambda y: y.t), t)) AS mp, list_filter(v.concepts, lambda t: list_contains(list_transform(q.qc, lambda y: y.t), t)) AS mc,
    list_intersect(v.attrs, q.qa) AS ma, list_intersect(v.toks, q.qw) AS mt FROM qq q JOIN ev v ON v.video_id = q.video_id) x JOIN ev v ON v.event_id = x.vid)),
sd AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, start_seconds, event_id) AS seed_rank FROM
  (SELECT *, {_six(f'least(1.0, 0.77 * ({_RELEVANCE}) + 0.1 * support + 0.08 * ((acov + ccov) / 2.0) + joint)')} AS score FROM pr WHERE len(mp) + len(mc) + len(ma) + len(mt) > 0)) WHERE seed_rank <= 20),
ed AS (SELECT * FROM ({edges}) g WHERE source <> target AND EXISTS (SELECT 1 FROM ev WHERE ev.event_id = g.source) AND EXISTS (SELECT 1 FROM ev WHERE ev.event_id = g.target)),
fw AS MATERIALIZED (SELECT source AS at, arg_max(target, place) AS nxt FROM ed GROUP BY 1), bw AS MATERIALIZED (SELECT target AS at, arg_max(source, place) AS nxt FROM ed GROUP BY 1),
walk AS (SELECT event_id AS seed, event_id AS id, 0 AS off, 1 AS way, [event_id] AS path FROM ev UNION ALL SELECT event_id, event_id, 0, -1, [event_id] FROM ev
  UNION ALL SELECT w.seed, n.nxt, w.off + w.way, w.way, list_append(w.path, n.nxt) FROM walk w JOIN (SELECT *, 1 AS way FROM fw UNION ALL SELECT *, -1 FROM bw) n ON n.at = w.id AND n.way = w.way WHERE abs(w.off) < 2 AND NOT list_contains(w.path, n.nxt)),
near AS MATERIALIZED (SELECT sd.question_id, sd.seed_rank, w.off, pr.event_id, pr.event_index, pr.start_seconds, pr.end_seconds, pr.support, pr.acov, pr.ccov, pr.mp, pr.mc, pr.ma, pr.mt AS words, pr.relevance,
  list_concat(list_transform(pr.mp, lambda x: 'p:' || x), list_transform(pr.mc, lambda x: 'c:' || x), list_transform(pr.ma, lambda x: 'a:' || x)) AS terms
  FROM sd JOIN walk w ON w.seed = sd.event_id AND (w.off <> 0 OR w.way = 1) JOIN pr ON pr.question_id = sd.question_id AND pr.event_id = w.id
  WHERE NOT coalesce((sd.relation = 'after' AND w.off < 0) OR (sd.relation = 'before' AND w.off > 0), false)),
s0 AS (SELECT sd.question_id, sd.seed_rank, sd.relation, 0 AS lo, 0 AS hi, true AS alive, n.terms, n.words, CAST(NULL AS VARCHAR) AS reason FROM sd JOIN near n ON n.question_id = sd.question_id AND n.seed_rank = sd.seed_rank AND n.off = 0),
{_hop(0)}, {_hop(1)},
gm AS (SELECT s.question_id, s.seed_rank, any_value(s.reason) AS expansion_reason, list(n.event_id ORDER BY off) AS event_ids, arg_min(n.start_seconds, off) AS first_start, min(n.start_seconds) AS start_seconds, max(n.end_seconds) AS end_seconds,
    list_sort(list_distinct(flatten(list(mp)))) AS gp, list_sort(list_distinct(flatten(list(mc)))) AS gc, list_sort(list_distinct(flatten(list(ma)))) AS ga, list_distinct(flatten(list(n.words))) AS gw,
    avg(support) AS sup, (avg(acov) + avg(ccov)) / 2.0 AS cov, count(*) AS size, max(relevance) FILTER (len(n.terms) + len(n.words) > 0) AS alone, any_value(n.event_id) FILTER (off = 0) AS anchor, -min(s.lo) AS step
  FROM s2 s JOIN near n ON n.question_id = s.question_id AND n.seed_rank = s.seed_rank AND n.off BETWEEN s.lo AND s.hi GROUP BY 1, 2),
gs AS (SELECT *, {_six(_RELEVANCE)} AS rel, {_six(f'least(1.0, 0.77 * ({_RELEVANCE}) + 0.1 * sup + 0.08 * cov + joint)')} AS base FROM (SELECT gm.*, x.video_id, x.qp, x.qc, x.qa, x.qw, {_scores('gp', 'gc', 'ga', 'gw')} FROM gm JOIN qq x USING (question_id))),
gt AS (SELECT *, greatest(0.0, rel - alone) AS gain, CASE WHEN size = 1 THEN base ELSE {_six('least(1.0, base + 0.08 * greatest(0.0, rel - alone)) - 0.015 * (size - 1)')} END AS score FROM gs),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_start, event_ids) AS rank FROM (SELECT * FROM gt QUALIFY row_number() OVER (PARTITION BY question_id, event_ids ORDER BY score DESC, seed_rank) = 1) QUALIFY rank <= 5)"""


_CHAIN_SQL = "SELECT l.video_id, l.event_id AS source, n.event_id AS target, 0 AS place FROM e l JOIN e n ON n.video_id = l.video_id AND n.event_index = l.event_index + 1"
# Edges that leave events out, lead back, meet in one event, and end in events that are not there.
_JUMPS_SQL = "SELECT l.video_id, l.event_id AS source, n.event_id AS target, 2 * l.event_index + 1 AS place FROM e l JOIN e n ON n.video_id = l.video_id AND n.event_index = (l.event_index * 7 + 3) % 31 UNION ALL SELECT video_id, event_id, event_id || 'x', 1000000 FROM e UNION ALL SELECT l.video_id, l.event_id, n.event_id, 2 * l.event_index + 1000 FROM e l JOIN e n ON n.video_id = l.video_id AND n.event_index = l.event_index - 2 WHERE l.event_index % 3 = 0"
_GROUP_COLUMNS = """question_id, CAST(rank AS INT) AS rank, array_to_string(event_ids, ',') AS events, anchor AS anchor_event_id, start_seconds, end_seconds, round(score, 6) AS score, array_to_string(gp, ',') AS predicates, array_to_string(gc, ',') AS concepts, array_to_string(ga, ',') AS attributes, expansion_reason,
  array_to_string(list_concat(list_transform(gp, lambda x: 'query_action:' || x), list_transform(gc, lambda x: 'query_concept:' || x), [anchor], flatten(list_transform(list_reverse(event_ids[1:step]), lambda x: ['inverse:temporal_before', x])), flatten(list_transform(event_ids[step + 2:], lambda x: ['temporal_before', x]))), ' ') AS path,
  rel AS query_relevance, round(ac, 6) AS action_coverage, round(cc, 6) AS concept_coverage, round(tc, 6) AS attribute_coverage, round(lc, 6) AS lexical_coverage, round(sup, 6) AS structural_support, round(cov, 6) AS representative_coverage, joint AS joint_match_bonus,
  CASE WHEN size > 1 THEN round(gain, 6) END AS multi_event_coverage_gain, CASE WHEN size > 1 THEN round(0.015 * (size - 1), 6) END AS expansion_penalty"""


def _group_rows(ranked):
    return ranked.select(
        "question_id", "rank", F.array_join("event_ids", ",").alias("events"), "anchor_event_id", "start_seconds", "end_seconds", "score", F.array_join("matched_predicates", ",").alias("predicates"),
        F.array_join("matched_concepts", ",").alias("concepts"), F.array_join("matched_attributes", ",").alias("attributes"), "expansion_reason", F.array_join("reasoning_path", " ").alias("path"), "components.*",
    )


@query("event_groups_ranked", f"{_group_cte(_CHAIN_SQL)} SELECT {_GROUP_COLUMNS} FROM rk")
def event_groups_ranked(spark, sf_dir):
    questions, built = _lookup(spark, sf_dir)
    return _group_rows(graphquery.retrieve_groups(questions, built)[1])


@query("event_groups_on_edges", f"{_group_cte(_JUMPS_SQL)} SELECT {_GROUP_COLUMNS} FROM rk")
def event_groups_on_edges(spark, sf_dir):
    """Groups grown along a given edge table instead of the order of events."""
    questions, built = _lookup(spark, sf_dir)
    ids = built.select("video_id", "event_index", F.col("event_id").alias("source"))
    other = built.select("video_id", F.col("event_index").alias("_n"), F.col("event_id").alias("target"))

    def to(number, place, rows=ids):
        return rows.withColumns({"_n": number, "place": place}).join(other, ["video_id", "_n"]).select("video_id", "source", "target", F.col("place").cast("bigint").alias("place"))

    i = F.col("event_index")
    jumps = to((i * 7 + 3) % 31, 2 * i + 1).unionByName(to(i - 2, 2 * i + 1000, ids.filter(i % 3 == 0)))
    lost = ids.select("video_id", "source", F.concat("source", F.lit("x")).alias("target"), F.lit(1000000).cast("bigint").alias("place"))
    edges = jumps.unionByName(lost).withColumn("relation", F.lit("temporal_before"))
    return _group_rows(graphquery.retrieve_groups(questions, built, edges=edges, order="place")[1])


_EVIDENCE_SQL = f"""{_group_cte(_CHAIN_SQL)},
vs AS (SELECT *, row_number() OVER (PARTITION BY question_id, event_id ORDER BY rank, position) AS visit FROM (SELECT question_id, rank, score, gp, gc, unnest(event_ids) AS event_id, generate_subscripts(event_ids, 1) - 1 AS position FROM rk)),
rv AS (SELECT vs.*, rp.clip_id, rp.start_seconds, rp.end_seconds, rp.role, rp.selection_score, row_number() OVER (PARTITION BY vs.question_id, vs.rank, vs.position ORDER BY len(list_filter(rp.covered_actions, lambda t: list_contains(list_transform(x.qp, lambda y: y.t), t))) DESC,
    len(list_filter(rp.covered_informative_concepts, lambda t: list_contains(list_transform(x.qc, lambda y: y.t), t))) DESC, rp.selection_score DESC, rp.clip_index) - 1 AS i FROM vs JOIN rp USING (event_id) JOIN qq x ON x.question_id = vs.question_id),
nb AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, position, i) AS evidence_rank FROM rv WHERE i // 2 + 1 = visit)
SELECT question_id, CAST(evidence_rank AS INT) AS evidence_rank, clip_id, start_seconds, end_seconds, round(score, 6) AS confidence, event_id, CAST(rank AS INT) AS candidate_rank, role AS representative_role, selection_score AS representative_selection_score FROM nb WHERE evidence_rank <= 5"""


@query("graph_evidence", _EVIDENCE_SQL)
def graph_evidence(spark, sf_dir):
    questions, built = _lookup(spark, sf_dir)
    normalized, ranked = graphquery.retrieve_groups(questions, built)
    return graphquery.select_evidence(ranked, normalized, built).drop("video_id")


@query(
    "event_catalogue",
    f"""{_REP_CTE} SELECT e.video_id, e.event_id, e.event_index, e.start_seconds, array_to_string(e.predicates, ',') AS predicates, array_to_string(list_filter(e.concepts, lambda x: NOT list_contains({_STOP}, x)), ',') AS concepts, c.summary, c.tool AS visible_instruments
        FROM e JOIN rp ON rp.event_id = e.event_id AND rp.j = 1 JOIN c ON c.clip_id = rp.clip_id""",
)
def event_catalogue(spark, sf_dir):
    signed = _signed(spark, sf_dir)
    out = graphquery.event_catalogue(events.build_events(events.assign_events(signed.select(*_EVENT_COLUMNS))), signed)
    return out.withColumns({c: F.array_join(c, ",") for c in ("predicates", "concepts", "visible_instruments")})


@query(
    "event_frame_groups",
    f"""{_REP_CTE} SELECT e.video_id, e.event_id, z.clip_id, z.start_seconds, z.end_seconds, z.clip_id || '/0 ' || z.clip_id || '/2 ' || z.clip_id || '/5 ' || z.clip_id || '/7' AS reader_frame_paths,
        CASE WHEN e.event_index % 2 = 0 THEN 'event_onset_clip' ELSE 'event_representative_clip' END AS selection, NULL AS reason FROM e JOIN rp ON rp.event_id = e.event_id AND rp.j = 1 JOIN z ON z.clip_id = CASE WHEN e.event_index % 2 = 0 THEN e.clips[1] ELSE rp.clip_id END
        UNION ALL SELECT video_id, event_id || 'x', NULL, NULL, NULL, NULL, NULL, 'unknown_event' FROM e""",
)
def event_frame_groups(spark, sf_dir):
    signed = _signed(spark, sf_dir)
    # Read twice, as requests and as what answers them.
    built = cut_lineage(events.build_events(events.assign_events(signed.select(*_EVENT_COLUMNS))))
    chosen = built.select(
        F.col("event_id").alias("question_id"), "video_id", "event_id", (F.col("event_index") % 2 == 0).alias("prefer_onset")
    )
    names = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(F.col("clip_id"), F.lit("/"), i.cast("string")))
    # One more request names an event that its recording does not have.
    chosen = chosen.unionByName(built.select(F.concat(F.lit("lost"), "event_id").alias("question_id"), "video_id", F.concat("event_id", F.lit("x")).alias("event_id"), F.lit(True).alias("prefer_onset")))
    good, bad = graphquery.event_frame_groups(chosen, built, signed.select("video_id", "clip_id", "start_seconds", "end_seconds", names.alias("frame_paths")), 4)
    rows = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True).drop("question_id")
    return rows.withColumn("reader_frame_paths", F.array_join("reader_frame_paths", " "))


_SEED_EVENTS = """SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE concat('u', user_id % 20) END AS video_id, concat('e', event_id) AS event_id, CAST(event_id AS DOUBLE) AS start_seconds,
    event_type AS p, concat('g', user_id % 12) AS c, concat('w', event_id % 50) AS t, CAST(event_id % 97 AS DOUBLE) / 100 AS support, CAST(user_id % 5 AS DOUBLE) / 4 AS cover FROM {events}"""
_SEED_QUESTIONS = """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'hot' ELSE concat('u', c_custkey % 20) END AS video_id, c_custkey AS question_id,
    CASE WHEN c_mktsegment < 'C' THEN 'click' WHEN c_mktsegment < 'I' THEN 'purchase' END AS p, concat('g', c_nationkey) AS c, concat('w', c_custkey % 60) AS t FROM {customer}"""
_SEED_USED = "(CASE WHEN q.p IS NULL THEN 0 ELSE 0.5 END::DOUBLE + 0.35::DOUBLE + 0.1::DOUBLE)"
_SEED_HITS = "coalesce((e.p = q.p)::INT, 0) AS a, (e.c = q.c)::INT AS b, (e.t = q.t)::INT AS l"


@query(
    "seeds_of_hot_recording",
    f"""WITH e AS ({_SEED_EVENTS.format(events='events')}), q AS ({_SEED_QUESTIONS.format(customer='customer')}), m AS (SELECT q.question_id, e.event_id, e.start_seconds, e.support, e.cover, {_SEED_USED} AS used, {_SEED_HITS} FROM q JOIN e ON e.video_id = q.video_id),
        s AS (SELECT *, {_six("least(1.0, 0.77::DOUBLE * ((0.5::DOUBLE * a + 0.35::DOUBLE * b + 0.1::DOUBLE * l) / used) + (0.1::DOUBLE * support + 0.08::DOUBLE * cover) + 0.05::DOUBLE * (a * b))")} AS score FROM m WHERE a + b + l > 0)
        SELECT question_id, event_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, start_seconds, event_id) AS INT) AS seed_rank FROM s QUALIFY seed_rank <= 20""",
)
def seeds_of_hot_recording(spark, sf_dir):
    """Customers ask about events of a recording; one recording holds a third of both and is cut into many blocks."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    rows = spark.sql(_SEED_EVENTS, events=table(spark, sf_dir, "events"))
    asked = spark.sql(_SEED_QUESTIONS, customer=table(spark, sf_dir, "customer"))
    rows = rows.select(
        "video_id", "event_id", "start_seconds", one("p").alias("predicates"), one("c").alias("concepts"), none.alias("attribute_values"), one("t").alias("tokens"),
        F.col("support").alias("structural_support_score"), F.col("cover").alias("representative_action_coverage"), F.col("cover").alias("representative_entity_coverage"),
    )
    weights = lambda c, w: F.transform(one(c), lambda _: F.lit(w))
    asked = asked.select(
        "video_id", "question_id", one("p").alias("query_predicates"), weights("p", 1.5).alias("predicate_weights"), one("c").alias("query_concepts"), weights("c", 1.25).alias("concept_weights"),
        none.alias("query_attributes"), one("t").alias("query_tokens"),
    )
    return graphquery.seed_events(asked, rows, 20, right_rows=200).select("question_id", "event_id", "seed_rank")
