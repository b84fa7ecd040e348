"""Credential contexts and words counted in the texts."""

import math
import random
from functools import lru_cache

import pytest

from spanlens.llm import secrets

NAMED = [
    ("aws_secret_access_key = ", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ9vKpLmTx"), ("SECRET_KEY=", "9fj2kQpLw83zXk29"), ("db_pwd: ", "Xk29fjQpLw83z"),
    ('DB_PASSWORD="', "x$9!kQ#27pLz@w"), ('client_secret="', "!q#9Zt$7Lm@2"), ("the api_token is ", "xK9#vQ2!pL7zW"),
]


@pytest.mark.parametrize("before,value", NAMED)
def test_names_inside_longer_names(before, value):
    base, added, cost = secrets.scan_text(before + value, secrets.GuessCost(), 10.0)
    assert cost > 10 and (base or added == [(len(before), "guess", len(before) + len(value))])


def test_counted_words_are_cheap(spark):
    texts = ["understanding comes with time", "an understanding of rules", "Understanding, again", "the secret is understanding"]
    texts += ["the secret is zqjxvkwpyrmt"] * 5  # copies do not make a word of it
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.text: r.secrets for r in secrets.find_secrets(docs).collect()}
    assert got[texts[3]].added == [] and got[texts[3]].max_guess_log10 < 10
    assert [(s.start, s.kind, s.end) for s in got[texts[4]].added] == [(14, "guess", 26)]
    ranks = {r.word: r["rank"] for r in secrets.word_ranks(docs).collect()}
    assert ranks == {"the": 1, "understanding": 2}
    # Much other text around changes neither the spans nor, but for its own more frequent words, the rank.
    more = docs.unionByName(spark.range(20_000).selectExpr("-id - 1 AS doc_id", "'many other words stand in this text ' || repeat('and again ', 20) AS text"))
    again = {r.text: r.secrets for r in secrets.find_secrets(more.repartition(4)).where("doc_id >= 0").collect()}
    assert {t: s.added for t, s in again.items()} == {t: s.added for t, s in got.items()}


CLEAN = [
    "Our opinion: Weltanschauung", "shopping: supermarktregal", "The compass: northwestward", "mapping: kubernetes", "passage: understanding", "passenger: Konstantinopel",
    "spinning: bluthochdruck", "PASSAGE: Weltanschauung", "tokenizer: Konstantinopel", "the keyboard is northwestward",
]


@pytest.mark.parametrize("text", CLEAN)
def test_words_that_hold_a_name_are_no_context(text):
    assert secrets.credential_values(text) == []


@pytest.mark.parametrize("name", ["password", "dbPassword", "DB_PASSWORD", "my.pin", "old-token", "secrets", "apiKey2", "login"])
def test_names_set_off_are_contexts(name):
    assert [v for _, _, v in secrets.credential_values(f"{name}: Weltanschauung!")] == ["Weltanschauung"]


def cheapest(value, words):
    """The least cost over all cuts, each segment priced on its own by every rule it fits."""
    low, step = value.lower(), math.log10(2)
    walk = secrets.GuessCost._walks(low)

    @lru_cache(None)
    def best(i):
        if i == len(value):
            return 0.0
        costs = [secrets._char_cost(value[i]) + best(i + 1)]
        for j in range(i + 2, len(value) + 1):
            for form, extra in ((low, 0.0), (low.translate(secrets.LEET), 0.5)):
                if j - i >= 3 and form[i:j] in words:
                    changed = 0.0 if value[i:j] == low[i:j] else 0.3 if value[i + 1 : j] == low[i + 1 : j] else 0.5 * (j - i)
                    costs.append(math.log10(words[form[i:j]] + 1) + extra + changed + step + best(j))
                    break
            m = secrets.YEAR.match(value, i)
            costs += [math.log10(120) + step + best(j)] if m and m.end() == j else []
            m = secrets.DATE.match(value, i)
            costs += [math.log10(36_500) + (0.6 if m[1] else 0.0) + step + best(j)] if m and m.end() == j else []
            if j == walk[i] and j - i >= 3:
                costs.append(math.log10(47) + 0.5 * (j - i - 1) + step + best(j))
            for unit in range(1, min(8, (j - i) // 2) + 1):
                times, rest = divmod(j - i, unit)
                starts_here = i < unit or value[i - unit : i] != value[i : i + unit]
                if rest == 0 and times > 1 and value[i:j] == value[i : i + unit] * times and not value.startswith(value[i : i + unit], j) and starts_here:
                    costs.append(sum(map(secrets._char_cost, value[i : i + unit])) + math.log10(times) + step + best(j))
        return min(costs)

    return best(0)


def test_cost_is_the_cheapest_of_all_cuts():
    rng = random.Random(3)
    model = secrets.GuessCost(("password", "dragon", "sun", "shine"))
    pieces = ["password", "Dragon", "SUN", "sh1ne", "p4ssword", "1999", "12/05/87", "aaaa", "abab", "qwert", "xK9#", "z", "7", "abcd", "é"]
    counted = {"zebra": 40, "sunshine": 2}
    for _ in range(400):
        value = "".join(rng.choices([*pieces, "zebra", "Sunshine"], k=rng.randrange(1, 5)))
        assert model.cost(value, counted) == pytest.approx(cheapest(value, {**model.rank, **{w: len(model.rank) + r for w, r in counted.items()}})), value
