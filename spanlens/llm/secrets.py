"""Secrets in texts: three base patterns, and credential values whose guess cost is too high for a chosen word."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlens.llm.common import fresh, row_key, staged

# Fixed values of the base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

# Where a value is a credential: a name, an assignment (or "is"), a value up to a space, quote or bracket. The name is a word, or a
# part of a longer name that "_", ".", "-", a digit or a step from lower to upper case sets off (db_pwd, dbPassword, AWS_SECRET_ACCESS_KEY).
_WORDS = r"(?i:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credential|api[ _-]?key|(?:access|private|auth)[ _-]?key|login)[sS]?"
NAME = rf"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])){_WORDS}(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
CONTEXT = re.compile(
    rf"""(?:{NAME}[A-Za-z0-9_.-]{{0,64}}["']?\s{{0,4}}[:=]|(?<![A-Za-z0-9]){NAME}(?:[_.-][A-Za-z0-9_.-]{{0,63}})?["']?\s{{0,4}}\b(?i:is)\b)"""
    r"""\s{0,4}["']?([^\s"'`,;<>()\[\]{}]+)""",
    re.ASCII,
)
HINTS = ("pass", "pwd", "pin", "secret", "token", "credential", "key", "login")

# Fits wherever CONTEXT does, and is cheap: a hint and soon after it an assignment or "is".
LOOSE = rf"""(?i)(?:{'|'.join(HINTS)})[A-Za-z0-9_.-]{{0,100}}["']?\s{{0,4}}(?:[:=]|is)"""

# Words by rank: what people choose first, then everyday words. Words counted in the texts follow.
COMMON_WORDS = (
    "password", "qwerty", "dragon", "monkey", "letmein", "football", "baseball", "welcome", "login", "master", "hello",
    "admin", "sunshine", "princess", "shadow", "flower", "secret", "freedom", "whatever", "trustno", "summer", "winter",
    "spring", "autumn", "iloveyou", "love", "test", "user", "guest", "root", "default", "changeme", "example", "sample",
    "token", "value", "your", "string", "none", "null", "true", "false", "here", "the", "and", "for", "with", "that",
    "this", "from", "have", "not", "are", "was", "all", "new", "old", "one", "two", "red", "blue", "green", "black",
    "white", "house", "home", "work", "office", "school", "family", "friend", "mother", "father", "summer", "street",
    "city", "river", "water", "fire", "light", "night", "happy", "money", "music", "game", "star", "moon", "king",
    "queen", "tiger", "eagle", "horse", "apple", "orange", "banana", "coffee", "cookie", "computer", "internet", "server",
    "system", "database", "company", "manager", "service", "account", "private", "public", "access", "key", "code", "pass",
)

# A counted word: letters between characters that are neither letters nor digits; rarer ones cost brute force.
WORD = r"(?<![\p{L}\p{N}_])\p{L}{3,24}(?![\p{L}\p{N}_])"
MIN_WORD_COUNT = 3
SHORTEST, LONGEST = 3, 24

# Rows of a keyboard; a walk stays on neighbouring keys.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("430150$@!7", "aeoisosait")
DATE = re.compile(r"\d{1,4}([-/._]?)\d{1,2}\1\d{1,4}")
YEAR = re.compile(r"(?:19|20)\d\d")
LETTERS = re.compile(r"[^\W\d_]{3,}")
MIN_LOG10_GUESSES = 10.0
MIN_LENGTH = 8


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEY_ROWS):
        for x, key in enumerate(row):
            for dy in (-1, 0, 1):
                if 0 <= y + dy < len(KEY_ROWS):
                    line = KEY_ROWS[y + dy]
                    near.setdefault(key, set()).update(line[i] for i in (x - 1, x, x + 1) if 0 <= i < len(line) and line[i] != key)
    return near


NEAR = _neighbours()


def _char_cost(c: str) -> float:
    if "0" <= c <= "9":
        return 1.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return math.log10(26)
    return math.log10(33) if c < "\x80" else 2.0


class GuessCost:
    """log10 of the guesses for a value: the cheapest cut into words, dates, repeats, keyboard walks and single characters.

    ``best[j]`` is the cost of the first j characters. Each segment starts at a cut and costs the log of
    its own guesses plus the log of two for the choice of another segment. Words have bounded length,
    dates at most ten characters, repeats a unit of at most eight, and walks and repeats are taken at
    their full run only, so the time grows linearly with the value.
    """

    def __init__(self, words: tuple[str, ...] = COMMON_WORDS):
        self.rank = {}
        for word in words:
            self.rank.setdefault(word.lower(), len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)

    def cost(self, value: str, counted: Mapping[str, int] | None = None) -> float:
        """``counted`` ranks further words, behind those of the model."""
        counted, behind = counted or {}, len(self.rank)
        longest = max([self.longest, *map(len, counted)])
        n, low = len(value), value.lower()
        low = low if len(low) == n else value
        plain = low.translate(LEET)
        best = [0.0] + [math.inf] * n
        walk = self._walks(low)
        step = math.log10(2)
        for i in range(n):
            here = best[i]

            def reach(j: int, cost: float, here: float = here) -> None:
                if here + cost + step < best[j]:
                    best[j] = here + cost + step

            if here + _char_cost(value[i]) < best[i + 1]:
                best[i + 1] = here + _char_cost(value[i])
            for j in range(i + 3, min(n, i + longest) + 1):
                for form, extra in ((low, 0.0), (plain, 0.5)):
                    if rank := self.rank.get(form[i:j]) or behind * (form[i:j] in counted) + counted.get(form[i:j], 0):
                        changed = 0.0 if value[i:j] == low[i:j] else 0.3 if value[i + 1 : j] == low[i + 1 : j] else 0.5 * (j - i)
                        reach(j, math.log10(rank + 1) + extra + changed)
                        break
            if "0" <= value[i] <= "9":
                for pattern, guesses in ((YEAR, 120), (DATE, 36_500)):
                    if m := pattern.match(value, i):
                        reach(m.end(), math.log10(guesses) + (0.6 if m.lastindex and m[1] else 0.0))
            if walk[i] - i >= 3:
                reach(walk[i], math.log10(47) + 0.5 * (walk[i] - i - 1))
            for unit in range(1, min(8, (n - i) // 2) + 1):
                if value[i + unit] == value[i] and value.startswith(value[i : i + unit], i + unit):
                    if i >= unit and value[i - 1] == value[i + unit - 1] and i != 0 and value[i - unit : i] == value[i : i + unit]:
                        continue  # inside a longer run of the same unit, which was taken at its start
                    j = i + unit
                    while value.startswith(value[i : i + unit], j):
                        j += unit
                    reach(j, sum(map(_char_cost, value[i : i + unit])) + math.log10((j - i) // unit))
        return best[n]

    @staticmethod
    def _walks(low: str) -> list[int]:
        """The end of the keyboard walk (or run of equal steps in code points) that starts at each place."""
        n = len(low)
        end = list(range(1, n + 1))
        for i in range(n - 2, -1, -1):
            if low[i + 1] in NEAR.get(low[i], ()):
                end[i] = end[i + 1]
        i = 0
        while i < n - 1:
            d, j = ord(low[i + 1]) - ord(low[i]), i + 1
            if d in (1, -1):
                while j < n - 1 and ord(low[j + 1]) - ord(low[j]) == d:
                    j += 1
                if j - i >= 2:
                    end[i] = max(end[i], j + 1)
            i = j
        return end


def substrings(value: str) -> set[str]:
    """What a counted word could be in a value: runs of 3 to 24 letters of its lower case and of its unmasked form."""
    low = value.lower()
    low = low if len(low) == len(value) else value
    out = set()
    for form in {low, low.translate(LEET)}:
        for m in LETTERS.finditer(form):
            run = m[0]
            out.update(run[i:j] for i in range(len(run)) for j in range(i + SHORTEST, min(len(run), i + LONGEST) + 1))
    return out


def word_ranks(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, rank of all words of all texts seen at least MIN_WORD_COUNT times: 1 + how many words are more frequent.

    Values in credential contexts are no words by themselves, so a secret does not become one by its copies. No
    word is left out for the size of the table. Ranks come from how many words have each count, a table
    with fewer rows than the root of twice the words there are.
    """
    plain = F.regexp_replace(F.col(f"`{text}`"), CONTEXT.pattern, " ")
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = staged(found.where(F.col("n") >= MIN_WORD_COUNT), "words")
    ahead = F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    places = found.groupBy("n").agg(F.count("*").alias("k")).select("n", (F.coalesce(ahead, F.lit(0)) + 1).alias("rank"))
    return found.join(places, "n").select("word", "rank")


def value_costs(candidates: DataFrame, ranks: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """value, cost: the guess cost of each distinct value, with the ranks of the words it may hold met by a join."""
    model = GuessCost(words)

    @F.arrow_udf("array<string>")
    def parts(values: pa.Array) -> pa.Array:
        return pa.array([sorted(substrings(v.as_py())) for v in values], pa.list_(pa.string()))

    @F.arrow_udf("double")
    def cost(values: pa.Array, known: pa.Array) -> pa.Array:
        return pa.array([model.cost(v.as_py(), {k["word"]: k["rank"] for k in (w.as_py() or [])}) for v, w in zip(values, known)], pa.float64())

    values = candidates.select(F.explode("found.value").alias("value")).distinct()
    asked = values.select("value", F.explode(parts.asNondeterministic()("value")).alias("word"))
    known = asked.join(ranks, "word").groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("known"))  # no more than a value has substrings
    return values.join(known, "value", "left").select("value", cost.asNondeterministic()("value", "known").alias("cost"))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, each kind leftmost and without overlap."""
    low = text.lower()
    spans = []
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def credential_values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of the values in credential contexts."""
    low = text.lower()
    if not any(k in low for k in HINTS):
        return []
    found = [(m.start(1), m[1].rstrip(".!?:")) for m in CONTEXT.finditer(text)]
    return [(start, start + len(value), value) for start, value in found if len(value) >= MIN_LENGTH]


def scan_text(text: str, model: GuessCost, least: float) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]], float | None]:
    """Base spans, added spans ("guess": values of credential contexts outside base spans), highest guess cost seen, by the model's own words."""
    base = base_spans(text)
    costs = [(start, end, model.cost(value)) for start, end, value in credential_values(text)]
    added = [(start, "guess", end) for start, end, cost in costs if cost >= least and not any(s < end and start < e for s, _, e in base)]
    return base, added, max((c for _, _, c in costs), default=None)


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
FOUND = "start:bigint,end:bigint,value:string"
FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
ORDER = {"assign": 0, "access": 1, "hex": 2, "guess": 3}


def find_secrets(docs: DataFrame, text: str = "text", words: tuple[str, ...] = COMMON_WORDS, min_log10_guesses: float = MIN_LOG10_GUESSES) -> DataFrame:
    """``docs`` with a struct column ``secrets``: base spans, added spans and the highest guess cost of a credential value.

    Spans are (start, kind, end) in code points, end exclusive, by start and then kind. Added spans are
    values in credential contexts that cost at least 10^``min_log10_guesses`` guesses and touch no base
    span. Words cost by rank: ``words`` first, then those counted in all texts (``word_ranks``). The distinct values are
    listed first; only the words they may hold meet the counts in a join, so nothing is sent whole to the workers
    and no word is dropped for the size of the table. Long texts are scanned whole in linear time.

    Null and empty texts have no spans and a null cost. Repeated rows each get their spans. A column
    called ``secrets`` stays; the new one is then ``secrets_1``.
    """
    value = F.col(f"`{text}`")

    @F.arrow_udf(f"array<struct<{FOUND}>>")
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("start", "end", "value"), f)) for f in credential_values(t.as_py() or "")] for t in texts], FOUND_TYPE)

    @F.arrow_udf("array<struct<start:bigint,kind:string,end:bigint>>")
    def bases(texts: pa.Array) -> pa.Array:
        spans = [sorted(base_spans(t.as_py() or ""), key=lambda x: (x[0], ORDER[x[1]])) for t in texts]
        return pa.array([[dict(zip(("start", "kind", "end"), x)) for x in row] for row in spans], pa.list_(SPAN))

    context = F.coalesce(value.rlike(LOOSE), F.lit(False))
    candidates = docs.where(context).select(row_key(text).alias("key"), find.asNondeterministic()(value).alias("found")).where(F.size("found") > 0)
    candidates = staged(candidates.groupBy("key").agg(F.first("found").alias("found")), "credentials")  # equal keys are equal texts
    costs = value_costs(candidates, word_ranks(docs, text), words)
    priced = candidates.select("key", F.explode("found").alias("f")).select("key", "f.*").join(costs, "value")
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "cost")))
    priced = staged(priced.groupBy("key").agg(spans.alias("spans")), "priced")  # a text and its own values
    out, key, base, own = (fresh(docs, n) for n in ("secrets", "__key", "__base", "__spans"))
    # Only texts that may have a credential context move; the others keep their place.
    scanned = docs.withColumn(base, bases.asNondeterministic()(value))
    moving = scanned.where(context).withColumn(key, row_key(text)).join(priced.select(F.col("key").alias(key), F.col("spans").alias(own)), key, "left")
    resting = scanned.where(~context).withColumn(own, F.lit(None).cast("array<struct<start:bigint,end:bigint,cost:double>>"))
    columns = [F.col(f"`{c}`") for c in (*docs.columns, base, own)]
    every = moving.select(columns).unionByName(resting.select(columns))
    spans, known = F.coalesce(F.col(own), F.array().cast("array<struct<start:bigint,end:bigint,cost:double>>")), F.col(base)
    clear = lambda s: (s["cost"] >= min_log10_guesses) & ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.transform(F.filter(spans, clear), lambda s: F.struct(s["start"].alias("start"), F.lit("guess").alias("kind"), s["end"].alias("end")))
    result = F.struct(known.alias("base"), added.alias("added"), F.array_max(F.transform(spans, lambda s: s["cost"])).alias("max_guess_log10"))
    return every.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias(out))
