"""Ranked lexical search against a plain Python ranking."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanlens.llm import ranking
from tests.llm import rows as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(R.low(text))


def ranked(docs, items, k):
    """Sorted rows (item text, item id, rank, key, score); rows of one key with one score are alike."""
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df, out = Counter(t for _, c in own for t in c), []
    for name, text in dict.fromkeys(items):
        asked, found = Counter(terms(text)), []
        for key, c in own:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            found.append((-score, key is None, key or 0, key)) if score > 0 else None
        out += [(name, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


ITEMS = [(1, R.A), (2, "own end"), (3, None), (4, ""), (5, "LINE of a NOTICE second line of a notice, line"), (6, R.B), (6, R.B), (6, "x13 x1 größer Füße"), (None, "one two two text"), (7, "w1 " * 400)]


@pytest.mark.parametrize("block,tile,exact", [(300, 1024, 1 << 53), (500_000, 2, 40_000 * 10**6)])
def test_search_matches_a_plain_ranking(spark, monkeypatch, block, tile, exact):
    """Small blocks and tiles, and limits so low that single weights are parted, change nothing."""
    for name in ("TILE_ITEMS", "TILE_TERMS", "TILE_DOCS"):
        monkeypatch.setattr(ranking, name, tile)
    if exact != 1 << 53:
        whole = ranking.Tiles.__init__
        monkeypatch.setattr(ranking.Tiles, "__init__", lambda self, *a: whole(self, *a, exact=exact))
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = rows_of(ranking.search(R.edge_docs(spark), bench, k=3, block_terms=block))
    assert got == ranked([(i, t) for i, t, _, _ in R.TEXTS], ITEMS, 3)


def test_search_of_random_texts(spark):
    rng = random.Random(7)
    vocab = [f"t{i}" for i in range(60)]
    docs = [(i % 250, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 10, 80])))) for i in range(300)]  # many ties, some ids twice
    items = [(f"q{i}", " ".join(rng.choices(vocab + ["unseen"], k=rng.choice([1, 2, 8, 30])))) for i in range(25)]
    got = ranking.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(items, "item_id string, text string"))
    assert rows_of(got) == ranked(docs, items, 10)


def test_search_of_empty_tables_and_clashing_names(spark):
    docs, bench = R.edge_docs(spark), spark.createDataFrame(ITEMS, "rank bigint, score string")
    assert ranking.search(docs.limit(0), bench, item="rank", item_text="score").count() == 0
    assert ranking.search(docs, bench.limit(0), item="rank", item_text="score").count() == 0
    got = ranking.search(docs, bench, item="rank", item_text="score")
    assert got.columns == ["rank", "rank_1", "doc_id", "score"] and rows_of(got) == ranked([(i, t) for i, t, _, _ in R.TEXTS], ITEMS, 10)


def test_partial_sums_stay_exact():
    items = ranking.Items(list(range(40)), [" ".join(f"t{j} " * (j + 1) for j in range(i, i + 30)) for i in range(40)])
    df = np.arange(1, len(items.vocabulary) + 1)
    for exact in (1 << 53, 10**11, 10**7):
        tiles = ranking.Tiles(items, df, 1000, 50_000, exact)
        total = Counter()
        for low, high, item, term, value in tiles.tiles:
            most = {}
            for t, v in zip(term.tolist(), value.tolist()):
                most[t] = max(most.get(t, 0), v)
            assert sum(most.values()) * ranking.IMPACT_BOUND < exact and low <= min(most) and max(most) < high
            for i, t, v in zip(item.tolist(), term.tolist(), value.tolist()):
                total[i, t] += v
        want = {(int(i), int(tiles.rank[t])): int(n) * ranking.term_weight(1000, int(df[t])) for i, t, n in zip(items.item, items.term, items.repeats)}
        assert dict(total) == want
