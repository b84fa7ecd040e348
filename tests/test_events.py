import random

import pytest
from pyspark.sql import functions as F

from spanlens.catalog import graphs, inputs
from spanlens.functions import rules, vocab
from spanlens.operators import events, graph, graphquery, normalize
from spanlens.plans.ordered import capped_runs, with_position, with_previous
from tests import brute

CLIP = "clip_id string, video_id string, clip_index int, start_seconds double, end_seconds double, description " + normalize.DESCRIPTION_TYPE


def clip(i, action, subject, target, anatomy=("pale membrane", "vessel"), tools=("needle holder",), objects=("suture strand",), video="v7"):
    facts = (list(anatomy), list(tools), list(objects), [(subject, action, target)], [], ["frame shows it"])
    return (f"{video}/{i}", video, i, 20.0 * i, 20.0 * i + 20.0, ("Work goes on.", facts, [], []))


def build(spark, rows, **kw):
    signed = normalize.with_signature(normalize.normalize_clips(spark.createDataFrame(rows, CLIP)))
    return events.build_events(events.assign_events(signed), **kw).orderBy("event_index").collect()


def stitching():
    return [clip(0, "inserts", "needle holder", "suture"), clip(1, "guides", "needle holder", "suture"), clip(2, "passes through", "suture", "vessel")]


def test_steps_of_one_stitch_are_one_event(spark):
    [event] = build(spark, stitching())
    assert event.supporting_clip_ids == ["v7/0", "v7/1", "v7/2"] and (event.start_seconds, event.end_seconds) == (0.0, 60.0)
    assert [d.compatible_transitions for d in event.merge_details] == [[["insert", "guide"]], [["guide", "pass_through"]]]
    assert {d.action_relation for d in event.merge_details} == {"transition"}
    assert event.support_mode == "merged_event" and 0 < event.structural_support_score < 1
    assert {r.clip_id for r in event.representatives} == set(event.supporting_clip_ids) and event.representative_action_coverage == 1.0
    [short] = build(spark, stitching(), max_representative_clips=2)
    assert len(short.representatives) == 2 and short.representative_action_coverage < 1.0


def test_what_all_clips_show_links_none(spark):
    vague = dict(anatomy=("tissue",), tools=("tool",), objects=())
    assert len(build(spark, [clip(0, "inserts", "tool", "tissue", **vague), clip(1, "guides", "tool", "tissue", **vague)])) == 2
    # The same action on other things in other roles.
    apart = build(spark, [clip(0, "presses", "probe", "vessel", objects=("mesh",)), clip(1, "presses", "scissors", "suture", anatomy=("organ",))])
    assert [(e.support_mode, e.support_components.mean_transition_score) for e in apart] == [("singleton_evidence", None)] * 2


def test_repeated_action_goes_on_until_another(spark):
    rows = [clip(i, "cuts", "scissors", "mesh", tools=("scissors",), objects=("mesh",)) for i in range(3)]
    rows.append(clip(3, "emits light", "probe", "organ", anatomy=("organ",), tools=("probe",), objects=()))
    assert [e.supporting_clip_ids for e in build(spark, rows)] == [["v7/0", "v7/1", "v7/2"], ["v7/3"]]
    assert [len(e.supporting_clip_ids) for e in build(spark, [clip(i, "cuts", "scissors", "mesh", tools=("scissors",), objects=("mesh",)) for i in range(7)])] == [5, 2]


def test_normalisation_facts(spark):
    cases = {"Needle holder": "grasping_instrument", "two  suture strands": "thread_like_material", "aspiration\u3000tube": "suction_instrument", "clear fluid droplets": "clear_fluid", "odd substance": "generic_material"}
    rows = spark.createDataFrame([(k,) for k in cases], "s string")
    got = rows.select("s", rules.entity(rules.squeeze(F.col("s")), F.lit(None).cast("string"))["canonical"]).collect()
    assert {r[0]: r[1] for r in got} == cases
    phrases = {
        "holds and retracts": ["hold", "pull"], "is pulling and looping": ["pull", "loop_around"], "moves through": ["pass_through"],
        "pierced and pulled": ["pierce", "pull"], "wanders about": ["other_action"],
    }
    got = spark.createDataFrame([(k,) for k in phrases], "s string").select("s", rules.predicates(rules.squeeze(F.col("s")))).collect()
    assert {r[0]: r[1] for r in got} == phrases


@pytest.mark.parametrize("cap,width", [(1, 4), (3, 5), (5, 3), (5, 1), (5, 1000)])
def test_capped_runs_match_a_plain_loop(spark, cap, width):
    rng = random.Random(cap * 100 + width)
    rows, want = [], {}
    for key in range(12):
        at, links = sorted(rng.sample(range(60), rng.randint(1, 40))), []
        for i, order in enumerate(at):
            links.append(i > 0 and rng.random() < 0.85)
            rows.append((f"k{key}", order, f"r{key}_{order}", links[-1]))
        for order, run in zip(at, brute.runs(links, cap)):
            want[f"r{key}_{order}"] = run
    df = spark.createDataFrame(rows, "video_id string, clip_index int, clip_id string, ok boolean")
    out = capped_runs(df, "video_id", "clip_index", "clip_id", ["clip_id", "ok"], lambda p, c: p["clip_id"].isNotNull() & c["ok"], cap, width)
    assert {r.clip_id: r.run_index for r in out.collect()} == want
    order = {}
    for key, at, name, _ in rows:
        order.setdefault(key, []).append(name)
    before = {n: (names[i - 1] if i else None) for names in order.values() for i, n in enumerate(names)}
    assert {r.clip_id: (r.previous.clip_id if r.previous else None) for r in out.collect()} == before
    again = with_previous(df, "video_id", "clip_index", "clip_id", ["clip_id"], width=width).collect()
    assert {r.clip_id: (r.previous.clip_id if r.previous else None) for r in again} == before
    places = {n: i for names in order.values() for i, n in enumerate(names)}
    assert {r.clip_id: r.position for r in with_position(df, "video_id", "clip_index", "clip_id", width=width).collect()} == places


@pytest.fixture(scope="module")
def built(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("built"))
    signed = normalize.with_signature(normalize.normalize_clips(inputs.clip_descriptions(spark, sf_dir).filter("video_id IN ('0', '1', '2')")))
    events.assign_events(signed, range_width=32).write.parquet(folder + "/a")
    assigned = spark.read.parquet(folder + "/a")
    events.build_events(assigned).write.parquet(folder + "/e")
    return assigned, spark.read.parquet(folder + "/e")


def test_representatives_match_a_plain_loop(built):
    assigned, table = built
    clips = {}
    for r in assigned.collect():
        c = dict(index=r.clip_index, predicates=set(r.predicates), informative=set(r.informative), spec=0.6 * r.observation_specificity + 0.4 * r.argument_specificity)
        clips.setdefault(r.event_id, []).append((c, r))
    for e in table.collect():
        members = sorted((c for c, _ in clips[e.event_id]), key=lambda c: c["index"])
        ids = {r.clip_id: r.clip_index for _, r in clips[e.event_id]}
        moving = {ids[x] for d in e.merge_details if d.action_relation == "transition" for x in (d.from_clip_id, d.to_clip_id)}
        assert [(p.clip_index, p.reasons[0]) for p in e.representatives] == brute.representatives(members, moving, 3)


def test_groups_match_a_plain_loop(spark, sf_dir, built):
    _, table = built
    questions = graphs.graph_questions(spark, sf_dir).filter("video_id IN ('0', '1', '2')")
    normalized, ranked = graphquery.retrieve_groups(questions, table, left_rows=17, right_rows=13)
    recordings = {}
    for e in table.collect():
        recordings.setdefault(e.video_id, []).append((e.event_index, dict(
            predicates=set(e.predicates), concepts=set(e.concepts), attributes=set(e.attribute_values), tokens=set(e.tokens), start=e.start_seconds,
            support=e.structural_support_score, cover=(e.representative_action_coverage + e.representative_entity_coverage) / 2)))
    recordings = {v: [e for _, e in sorted(rows, key=lambda x: x[0])] for v, rows in recordings.items()}
    got = {}
    for r in ranked.collect():
        got.setdefault(r.question_id, []).append((r.rank, (r.first_event, r.last_event, round(r.score, 6), r.anchor_event)))
    for n in normalized.collect():
        q = dict(predicates=n.query_predicates, concepts=n.query_concepts, attributes=n.query_attributes, tokens=n.query_tokens, relation=n.relation)
        want = brute.groups(q, recordings[n.video_id])
        have = [x for _, x in sorted(got.get(n.question_id, []))]
        assert [w[2] for w in want] == pytest.approx([h[2] for h in have], abs=2e-6)
        assert [w[:2] for w in want] == [h[:2] for h in have], (n.question, want, have)


def test_evidence_budget(spark, sf_dir, built):
    _, table = built
    questions = graphs.graph_questions(spark, sf_dir).filter("video_id = '1'")
    normalized, ranked = graphquery.retrieve_groups(questions, table)
    picked = graphquery.select_evidence(ranked, normalized, table).collect()
    reps = {e.event_id: e.representatives for e in table.collect()}
    terms = {n.question_id: n for n in normalized.collect()}
    have = {}
    for r in picked:
        have.setdefault(r.question_id, []).append((r.evidence_rank, r.clip_id))
    walks = {}
    for r in ranked.collect():
        walks.setdefault(r.question_id, []).append((r["rank"], r.event_ids))
    for qid, walk in walks.items():
        n, out = terms[qid], []
        for _, ids in sorted(walk):
            for event in ids:
                order = sorted(reps[event], key=lambda x: (-len(set(x.covered_actions) & set(n.query_predicates)), -len(set(x.covered_informative_concepts) & set(n.query_concepts)), -x.selection_score, x.clip_index))
                out += [x.clip_id for x in order if x.clip_id not in out][:2]
        assert [c for _, c in sorted(have[qid])] == out[:5]


def test_catalogue_and_frames(built, spark):
    assigned, table = built
    clips = {r.clip_id: r for r in assigned.collect()}
    rows = {(e.video_id, e.event_id): e for e in table.collect()}
    shown = graphquery.event_catalogue(table, assigned).collect()
    assert len(shown) == len(rows)
    for r in shown:
        e = rows[r.video_id, r.event_id]
        first = clips[(e.representatives[0].clip_id if e.representatives else e.supporting_clip_ids[0])].description
        assert (r.summary, r.visible_instruments) == (first.summary, first.observed_facts.visible_instruments[:3])
        assert r.concepts == [c for c in e.concepts if c not in vocab.STOP_CONCEPTS] and r.predicates == e.predicates
    there = {c: [f"{c}/{i}" for i in range(8)] for c, r in clips.items() if r.clip_index % 3}
    frames = spark.createDataFrame([(clips[c].video_id, c, clips[c].start_seconds, clips[c].end_seconds, f) for c, f in there.items()], "video_id string, clip_id string, start_seconds double, end_seconds double, frame_paths array<string>")
    asked = [(f"q{i}", v, e, i % 2 == 0) for i, (v, e) in enumerate(sorted(rows))] + [("lost", "0", "event:0:99999", True)]
    chosen = spark.createDataFrame(asked, "question_id string, video_id string, event_id string, prefer_onset boolean")
    good, bad = graphquery.event_frame_groups(chosen, table, frames, 4)
    good, bad = {r.question_id: r for r in good.collect()}, {r.question_id: r.reason for r in bad.collect()}
    assert bad["lost"] == "unknown_event" and len(good) + len(bad) == len(asked)
    for name, video, event, onset in asked[:-1]:
        e = rows[video, event]
        order = ([] if onset else [r.clip_id for r in e.representatives]) + list(e.supporting_clip_ids)
        want = next((c for c in order if c in there), None)
        assert bad.get(name) == (None if want else "no_resolvable_clip")
        if want:
            assert good[name].clip_id == want and good[name].reader_frame_paths == [f"{want}/{i}" for i in (0, 2, 5, 7)]


def test_questions_step_along_the_timeline(spark):
    rows = [
        clip(0, "grasps and holds", "grasper", "mesh", anatomy=("organ",), tools=("grasper",), objects=("mesh",)),
        clip(1, "emits light", "probe", "pale membrane", anatomy=("pale membrane",), tools=("probe",), objects=()),
        clip(2, "loops around", "suture", "vessel", anatomy=("vessel",), tools=()),
    ]
    signed = normalize.with_signature(normalize.normalize_clips(spark.createDataFrame(rows, CLIP)))
    table = events.build_events(events.assign_events(signed)).cache()
    asked = [("next", "v7", "Which step comes after the mesh is held by the grasper?"), ("earlier", "v7", "Which step comes before looping the suture?"), ("none", "v7", "Who wrote the report?")]
    questions = spark.createDataFrame(asked, "question_id string, video_id string, question string")
    _, ranked = graphquery.retrieve_groups(questions, table, top_k=1, max_hops=1)
    got = {r.question_id: r for r in ranked.collect()}
    first, middle, last = (f"event:v7:{i:05d}" for i in range(3))
    assert (got["next"].anchor_event_id, got["next"].event_ids) == (first, [first, middle])
    assert got["next"].reasoning_path[-2:] == ["temporal_before", middle] and got["next"].expansion_reason == "query_after_context"
    assert (got["earlier"].anchor_event_id, got["earlier"].event_ids) == (last, [middle, last])
    assert got["earlier"].reasoning_path[-2:] == ["inverse:temporal_before", middle]
    assert [r.question_id for r in graphquery.unmatched(questions, ranked).collect()] == ["none"]


def test_steps_follow_the_last_edge_of_each_event(spark):
    """A plain walk over dictionaries, as edges overwrite each other in order; branches, loops, cycles and unknown ends."""
    rng = random.Random(5)
    for round_ in range(3):
        names = [f"e{i}" for i in range(12)]
        edges = [(v, rng.choice(names), rng.choice(names + ["lost"]), rng.choice(["temporal_before"] * 4 + ["contains"]), i) for v in "ab" for i in range(25)]
        table = spark.createDataFrame([(v, n) for v in "ab" for n in names], "video_id string, event_id string")
        steps = graphquery.event_steps(spark.createDataFrame(edges, "video_id string, source string, target string, relation string, place int"), table, 3, "place")
        want = set()
        for v in "ab":
            after, before = {}, {}
            for w, s, t, relation, _ in edges:
                if w == v and relation == "temporal_before" and s != t and t in names:
                    after[s], before[t] = t, s
            for n in names:
                want.add((v, n, 0, n))
                for sign, to in ((1, after), (-1, before)):
                    path = [n]
                    while len(path) <= 3 and to.get(path[-1]) not in (None, *path):
                        path.append(to[path[-1]])
                        want.add((v, n, sign * (len(path) - 1), path[-1]))
        got = [(r.video_id, r.seed_id, r.offset, r.event_id) for r in steps.collect()]
        assert len(got) == len(set(got)) and set(got) == want
