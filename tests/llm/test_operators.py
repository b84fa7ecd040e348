"""The operators against plain Python versions on awkward rows."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.llm import chat, decontaminate, jaccard, language, language_model, line_dedup, mixing, quality, secrets, token_counts
from spanlens.llm.common import shared_folder
from spanlens.llm.components import components
from tests.llm import rows as R


def tokenizer(name="piece_bpe_32k.model"):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.fixture(scope="module")
def docs(spark):
    return R.edge_docs(spark).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def random_texts(n, seed, words=400):
    """Texts with near copies at every distance from the threshold, shared passages and short texts."""
    rng = random.Random(seed)
    vocab = [f"t{i}" for i in range(words)]
    passage = " ".join(rng.choices(vocab, k=40))
    out = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and out:
            w = rng.choice(out[-60:]).split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randrange(5))]
        else:
            w = rng.choices(vocab, k=rng.choice([1, 2, 3, 5, 9, 12, 17, 25, 40, 80, 150]))
        out.append(" ".join(w) + (" " + passage if kind > 0.9 else ""))
    return out


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, docs, shingle, percent, monkeypatch):
    # Short limits send the same texts through long lists and blocks.
    for limits in ({}, {"HOT_LIST": 4, "SHORT_LIST": 3, "BLOCK_SETS": 5, "COLUMNS": 7}):
        for name, value in limits.items():
            monkeypatch.setattr(jaccard, name, value)
        texts = random_texts(700, 5)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
        got = {r.doc_id: r for r in jaccard.near_duplicates(df, shingle=shingle, percent=percent).collect()}
        want, sets = R.components(texts, shingle, percent)
        assert [got[i].component_id for i in range(len(texts))] == want
        assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]


def test_near_duplicates_of_awkward_rows(docs, empty):
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(R.TEXTS)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for i in (1, 2, 16) for r in by_id[i]} == {1}
    assert by_id[17][0].component_id == 10
    assert [(r.n_shingles, r.component_id) for i in (4, 5, 6) for r in by_id[i]] == [(0, 4), (0, 5), (0, 6)]
    assert by_id[None][0].component_id is None and by_id[None][0].n_shingles == 3
    assert jaccard.near_duplicates(empty).count() == 0


def test_subsets_and_heads_lose_no_link():
    for percent in (80, 90):
        for n, m in itertools.product(range(1, 31), repeat=2):
            need = jaccard.needed(n, m, percent)
            if need <= min(n, m):
                assert need in jaccard.subset_sizes(n, percent) and need in jaccard.subset_sizes(m, percent)
                assert n - need < jaccard.head_size(n, percent)
    assert jaccard.boundary({10: 1000}, 0, 50.0, 90) >= 10 and jaccard.boundary({29: 1000}, 0, 0.1, 90) < 29


def test_signature_is_a_proof():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**64, rng.integers(1, 20), dtype=np.uint64)]))
        if len(np.intersect1d(a, b)) >= jaccard.needed(len(a), len(b), 90):
            assert jaccard.may_link(jaccard.signature(a), len(a), jaccard.signature(b), len(b), 90)


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 200: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("heavy", [1 << 17, 4])
def test_language_model_base_is_exact(docs, empty, monkeypatch, heavy):
    monkeypatch.setattr(language_model, "HEAVY", heavy)  # 4: nearly all words go through the join
    got = language_model.score(docs, language_model.is_held_out(F.col("doc_id"))).collect()
    texts = [(i, t) for i, t, _, _ in R.TEXTS]
    want = sorted(zip([i is None for i, _ in texts], [i or 0 for i, _ in texts], R.base_scores(texts)))
    have = sorted((r.doc_id is None, r.doc_id or 0, (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.held_out)) for r in got)
    for (_, i, w), (_, j, h) in zip(want, have, strict=True):
        assert i == j and w[:3] == h[:3] and w[4] == h[4] and h[3] == pytest.approx(w[3], rel=1e-9)
    assert all(r.score < 0 for r in got)
    assert language_model.score(empty, language_model.is_held_out(F.col("doc_id"))).count() == 0


def test_log_filter_never_reads_below_the_level(spark):
    docs = spark.createDataFrame([(i, " ".join(f"a{j}" for j in range(i + 1))) for i in range(150)], "doc_id bigint, text string")
    grams = language_model.counted(docs, 16)
    for bits in (1 << 20, 1 << 15):
        model = language_model.build_filter(grams, bits, 16)
        assert model.bits <= bits
        words = language_model.hash_words([f"a{j}".encode() for j in range(150)])
        levels = model.levels(language_model.asked_keys(words, 4, 1))
        stored = language_model.level(np.arange(150, 0, -1))
        if bits == 1 << 20:
            assert (levels >= stored).all() and (levels > stored).mean() < 0.15
    missing = model.levels(language_model.asked_keys(language_model.hash_words([f"b{j}".encode() for j in range(1000)]), 4, 1))
    assert (missing > 0).mean() < 0.2


def test_held_out_texts_score_better_with_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_model.score(docs, language_model.is_held_out(F.col("doc_id"))).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_come_from_the_cache(spark, docs, empty, name):
    path, cache = tokenizer(name), f"{shared_folder(spark)}/cache-test-{time.time_ns()}"
    if name.endswith("model"):
        import sentencepiece

        count = lambda t, m=sentencepiece.SentencePieceProcessor(model_file=path): len(m.encode(t))
    else:
        from tokenizers import Tokenizer

        count = lambda t, m=Tokenizer.from_file(path): len(m.encode(t, add_special_tokens=False).ids)
    token_counts.token_counts(empty, cache, path).count()
    for _ in range(2):
        out = token_counts.token_counts(docs, cache, path, limit=20)
        got = out.select("text", "tokens", F.col("tokens_1").alias("new")).collect()  # an own column called tokens stays
        assert all(r.tokens == 7 for r in got)
        assert sorted((r.text or "", r.new.n_bytes, r.new.n_tokens, r.new.over_limit) for r in got) == sorted(
            (t or "", len((t or "").encode()), count(t or ""), count(t or "") > 20) for _, t, _, _ in R.TEXTS
        )
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("content_digest").distinct().count() == len({t or "" for _, t, _, _ in R.TEXTS})


def tree(spark, rows):
    return spark.createDataFrame(rows, "conv string, node bigint, parent bigint, role string, text string, score double")


def test_reply_trees_follow_the_best_branch(spark):
    rows = [
        ("t", 1, None, "user", "hi", 1.0), ("t", 2, 1, "assistant", "a", 0.2), ("t", 3, 1, "assistant", "b", 0.9), ("t", 4, 2, "user", "c", 5.0),
        ("t", 5, 3, "user", None, None), ("t", 6, 99, None, "lost parent", 0.0), ("u", 1, 2, "user", "cycle", 1.0), ("u", 2, 1, "user", "cycle", 1.0),
        (None, 1, None, "a:b\\", "## ### </turn> \\", 0.0), (None, 1, None, "a:b\\", "## ### </turn> \\", 0.0), ("v", None, 1, "user", "no id", 1.0),
    ]
    rows += [("deep", i, i - 1, "assistant" if i % 2 else "user", f"m{i}", 0.5) for i in range(200)]
    made = {(r.conv, r.branch): r for r in chat.format_trees(tree(spark, rows), "conv", "node", "parent", score=F.col("score"), keep=2).collect()}
    read = {k: chat.read_turns(r.formatted) for k, r in made.items()}
    assert read[("t", 1)] == [("user", "hi"), ("assistant", "a"), ("user", "c")]
    assert read[("t", 2)] == [("user", "hi"), ("assistant", "b"), ("user", "")]
    assert read[(None, 1)] == [("a:b\\", "## ### </turn> \\")]
    assert [t for _, t in read[("deep", 1)]] == [f"m{i}" for i in range(200)] and made[("deep", 1)].n_turns == 200
    assert {k[0] for k in made} == {"t", "deep", None}
    learned = chat.read_learned(made[("deep", 1)].formatted, [(s.start, s.end) for s in made[("deep", 1)].spans])
    assert learned == "".join(f"m{i}" for i in range(1, 200, 2))
    assert chat.format_trees(tree(spark, []), "conv", "node", "parent").count() == 0


def test_every_turn_survives_the_template():
    parts = ["#", "##", "###", " ", "\\", "</turn>", "<\\/turn>", "\n", ":", ": ", "### user: ", " </turn>\n", "é", "\U0001f600", ""]
    rng = random.Random(1)
    for _ in range(500):
        turns = [("".join(rng.choices(parts, k=rng.randrange(4))), "".join(rng.choices(parts, k=rng.randrange(6)))) for _ in range(rng.randrange(5))]
        turns += [("assistant", "".join(rng.choices(parts, k=5)))]
        text, spans = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert chat.read_learned(text, spans) == "".join(t for r, t in turns if r == "assistant")
        assert text.count("</turn>") == len(turns)


def test_linear_keeps_ties_and_null_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "assistant", None), (None, 3, None, "x")]
    nodes = chat.linear(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: chat.read_turns(r.formatted) for r in chat.format_trees(nodes, "conv_id", "node", "parent").collect()}
    assert got == {1: [("user", "a"), ("user", "b"), ("assistant", "")], None: [("", "x")]}


ITEMS = [(1, R.A), (2, "own end"), (3, None), (4, ""), (5, "LINE of a NOTICE second line of a notice third line of"), (6, R.B), (6, R.B), (None, "größer")]


@pytest.mark.parametrize("block", [500_000, 3])
def test_decontamination_matches_all_windows(spark, docs, empty, block):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.contamination(docs, bench, block_windows=block).select("doc_id", "text", "leaks").collect()
    assert len(got) == len(R.TEXTS)
    for r in got:
        n, hit, names = R.leaks(r.text, [("" if i is None else i, t) for i, t in ITEMS])
        spans = {p for a, b in zip(r.leaks.hit_starts, r.leaks.hit_ends) for p in range(a, b)}
        assert (r.leaks.n_words, r.leaks.n_hit, spans, r.leaks.items) == (n, len(hit), hit, sorted(names)), r.text
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("leaks.n_hit > 0").count() == 0


def test_line_dedup_keeps_the_first(docs, empty):
    got = line_dedup.remove_repeats(docs).select("doc_id", "text", "deduped").collect()
    want = R.kept_lines([(i, t) for i, t, _, _ in R.TEXTS])
    assert len(got) == len(R.TEXTS)
    for r in got:
        assert r.deduped.text == want[(r.doc_id, r.text)]
    by_id = {r.doc_id: r.deduped for r in got}
    assert by_id[8].text == "own start" and by_id[9].text == "" and by_id[9].n_removed == 6 and by_id[4].text is None
    assert line_dedup.remove_repeats(empty).count() == 0


def test_quality_measures_and_verdicts(spark, docs, empty):
    got = quality.measures(docs).select("text", "measures").collect()
    for r in got:
        m = r.measures
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == R.measures(r.text)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 0)], "doc_id bigint, quality int")
    judged = quality.judge(docs, labels).collect()
    assert len(judged) == len(R.TEXTS) and all(r.kept == (not r.base_failed) for r in judged)
    assert quality.judge(empty, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(R.TEXTS)


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 100, 0.01), (3, 200, 0.05), (1, 50, 0.3), (10, 2000, 0.01), (5, 5, 0.5), (0, 0, 0.1), (40, 100_000, 0.001)]
    got = spark.createDataFrame(cases, "k bigint, n bigint, p double").withColumn("t", quality.lower_tail("k", "n", "p")).collect()
    for r in got:
        if r.k >= r.n * r.p:
            assert r.t == 1.0
        elif r.n < 5000:
            assert r.t == pytest.approx(sum(comb(r.n, i) * r.p**i * (1 - r.p) ** (r.n - i) for i in range(r.k + 1)), rel=1e-9)
        else:
            assert 0 < r.t < 1e-10


def test_cutoffs_bound_false_rejections(spark):
    """A rule that rejects many good documents is not certified; one that tells bad from good is, where labels suffice."""
    fields = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
    rows = [("en", 1 if i % 4 else 0, (100, 500, 0 if i % 4 else 200, 10, i % 10, 0)) for i in range(8000)]
    rows += [("de", 1 if i % 4 else 0, (100, 500, 0 if i % 4 else 200, 10, 0, 0)) for i in range(40)]
    holdout = spark.createDataFrame(rows, f"lang string, quality int, measures struct<{fields.replace(' bigint', ':bigint')}>")
    got = {(r.stratum, r.rule): r for r in quality.certified_cutoffs(holdout, "lang").collect()}
    assert set(got) == {("en", "symbols")} and got[("en", "symbols")].n_false == 0
    assert got[("en", "symbols")].cutoff == 0.3  # the most lenient that catches all


def _holm_cutoffs(rows, risk, error, price):
    """Plain version: stepwise testing that hands the share of a finished chain to the others, until nothing changes."""
    from math import comb

    strata = sorted({r[0] for r in rows})
    chains = {}
    for stratum in strata:
        for rule, (measure, cuts) in quality.RULES.items():
            over, under = measure.split(" / ")
            cells = []
            for cut in cuts:
                out = [(q, m[over] / m[under] > cut) for s, q, m in rows if s == stratum]
                n, k = sum(q == 1 for q, _ in out), sum(q == 1 and o for q, o in out)
                p = risk / len(quality.RULES)
                tail = 1.0 if k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                cells.append((cut, tail, sum(q == 0 and o for q, o in out) - price * k))
            chains[stratum, rule] = cells
    done = set()
    while fresh := [c for c in chains if c not in done and all(t <= error / (len(chains) - len(done)) for _, t, _ in chains[c])]:
        done.add(fresh[0])
    picked = {}
    for c, cells in chains.items():
        passed = []
        for cut, tail, gain in cells:
            if c not in done and tail > error / (len(chains) - len(done)):
                break
            passed.append((gain, -len(passed), cut))
        if passed and max(passed)[0] > 0:
            picked[c] = max(passed)[2]
    return picked


@pytest.mark.parametrize("sizes,expected", [
    ((600, 420, 310), {"a", "b", "c"}),  # the last stratum only passes at a share the others have freed
    ((600, 310, 310), {"a"}),
    ((100, 100, 100), set()),
])
def test_finished_chains_free_their_share_of_the_error(spark, sizes, expected):
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    rows = [(s, int(i >= 20), (100, 500, 0 if i >= 20 else 100 + i * 5, 10, 0, 0)) for s, n in zip("abc", sizes) for i in range(n + 20)]
    fields = ", ".join(f"{n}:bigint" for n in names)
    holdout = spark.createDataFrame(rows, f"lang string, quality int, measures struct<{fields}>")
    got = {(r.stratum, r.rule): r.cutoff for r in quality.certified_cutoffs(holdout, "lang").collect()}
    assert got == _holm_cutoffs([(s, q, dict(zip(names, m))) for s, q, m in rows], 0.04, 0.05, 10.0)
    assert {s for s, _ in got} == expected


@pytest.mark.parametrize("text,least,most", [
    ("password", 0, 2), ("Password", 0, 2.5), ("qwertyuiop", 0, 7), ("aaaaaaaaaaaa", 0, 4), ("12/05/1987", 0, 6), ("xK9#vQ2!pL7z", 12, 30), ("abcabcabcabc", 0, 7), ("", 0, 0),
])
def test_guess_cost(text, least, most):
    assert least <= secrets.GuessCost().cost(text) <= most


def test_guess_cost_is_the_cheapest_cut_and_linear():
    model = secrets.GuessCost()
    assert model.cost("passwordzq7") <= model.cost("password") + model.cost("zq7") + 1
    start = time.perf_counter()
    model.cost("x9#Kq" * 20_000)
    model.cost("a" * 100_000)
    assert time.perf_counter() - start < 20


def test_secret_spans(docs, empty):
    got = secrets.find_secrets(docs).select("text", "secrets").collect()
    for r in got:
        assert [(s.start, s.kind, s.end) for s in r.secrets.base] == R.secret_spans(r.text)
    assert secrets.find_secrets(empty).count() == 0
    base, added, cost = secrets.scan_text("the passphrase is xK9#vQ2!pL7zW and pwd: sunshine99 token=abc", secrets.GuessCost(), 10.0)
    assert base == [] and [(k, "the passphrase is xK9#vQ2!pL7zW"[a:b]) for a, k, b in added] == [("guess", "xK9#vQ2!pL7zW")] and cost > 10
    assert secrets.scan_text("password: token: abcdefghij", secrets.GuessCost(), 99.0)[0] == []


def test_mixing_hits_targets(spark, docs, empty):
    for limit in (4_000, 2):
        mixing.SLICE_ROWS, before = limit, mixing.SLICE_ROWS
        try:
            got = mixing.mix(docs).collect()
            again = mixing.mix(docs.repartition(7)).collect()
        finally:
            mixing.SLICE_ROWS = before
        key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
        assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(R.TEXTS)
        total, by = sum(r.size for r in got), {}
        for r in got:
            by.setdefault(r.source, []).append(r)
            assert 0 <= r.taken <= 2 * r.size
        for rows in by.values():
            assert sum(r.taken for r in rows) == int(rows[0].target + 0.5) and rows[0].source_size == sum(r.size for r in rows)
        assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(empty).count() == 0


def test_water_level(spark):
    def level(rows, total):
        return mixing.water_level(spark.createDataFrame(rows, "source_size bigint, weight bigint"), total, 2.0)

    assert level([(10, 1), (10, 1)], 20.0) == 10.0
    assert level([(1, 5), (100, 1)], 50.0) == 48.0  # the first is clamped at 2
    assert level([(1, 5), (5, 2), (100, 1)], 60.0) == 48.0  # one clamp pushes the next over its cap
    assert level([(1, 1)], 99.0) is None and level([], 0.0) is None


def brute_posteriors(scores, transitions):
    n, k = scores.shape
    weight = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = sum(scores[t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:]))
        w = np.exp(w + np.log(np.exp(transitions[:, path[0]]).sum()))  # a free state before the first word
        for t, y in enumerate(path):
            weight[t, y] += w
    return weight / weight.sum(axis=1, keepdims=True)


def test_forward_backward_in_segments(monkeypatch):
    rng = np.random.default_rng(2)
    lengths = np.array([1, 7, 3, 6])
    scores, transitions = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    want = np.concatenate([brute_posteriors(s, transitions) for s in np.split(scores, np.cumsum(lengths)[:-1])])
    for segment in (1, 2, 3, 128):
        monkeypatch.setattr(language, "SEGMENT", segment)
        alpha, beta, _ = language.forward_backward(scores, transitions, lengths)
        assert np.allclose(language.marginals(alpha, beta), want)


def test_languages_of_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = language.is_held_out(F.col("doc_id"))
    model = language.train(docs.where(~held), per_label=100)
    got = language.label_texts(docs.where(held), model).select((F.col("lang") == F.col("language.lang_pred")).alias("ok"), "language.score").collect()
    assert sum(r.ok for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    texts = {r.lang: r.text for r in docs.where(held & (F.length("text") > 400)).dropDuplicates(["lang"]).collect()}
    mixed = " ".join(texts["en"].split()[:50] + texts["de"].split()[:50])
    runs = language.label_texts(spark.createDataFrame([(mixed,)], "text string"), model, with_runs=True).first().language.runs
    assert [r.lang for r in runs if r.end - r.start > 20] == ["en", "de"]


def test_languages_of_awkward_rows(spark, docs, empty):
    model = language.train(docs)
    got = language.label_texts(docs, model).select("text", "language.lang_pred", "language.score").collect()
    assert len(got) == len(R.TEXTS)
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    nobody = language.train(empty)
    assert not nobody.labels and language.label_texts(docs, nobody).where("language.lang_pred <> 'und'").count() == 0
    assert language.label_texts(empty, model).count() == 0
