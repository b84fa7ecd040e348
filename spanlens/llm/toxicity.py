"""Toxicity of texts by a weighted finite-state grammar over learned and fixed word classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.llm.common import found_in, fresh, hash_words, staged

TOXIC_TEXTS, CLEAN_TEXTS = 4_000, 16_000
MIN_CONTEXTS = 6
MIN_RATIO = 10.0
MIN_EVIDENCE = 25.0
MAX_WEIGHT = 8.0
THREAT_WEIGHT = 4.0
PREFIXES = (4, 5, 6, 7, 8)  # bytes of a lower-case word
CHUNK_BYTES = 500_000

# Word classes: insult, threat, target, negation, report, anything else. A small i or h is a hit that was reported or denied.
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = "I", "H", "T", "N", "R", "o", "."

# Fixed words of each class in English, German, French and Spanish.
CLASS_WORDS = {
    THREAT: "kill murder destroy hurt beat stab shoot strangle töten umbringen schlagen zerstören erschießen tuer frapper détruire égorger matar golpear destruir disparar",
    TARGET: "you your you're u he she they them him her du dich dir ihr euch sie er tu toi te vous ils elles il elle tú usted ustedes ellos ellas",
    NEGATION: "not no never don't isn't aren't nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ningún sin",
    REPORT: "said says wrote quoted claimed reported called sagte schrieb zitierte meinte dit écrit citait dijo escribió citó",
}

# Letters, digits and apostrophes stay; what ends a clause becomes byte 1, all else a space. Bytes of other scripts stay.
_FOLD = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else c + 32 if 65 <= c <= 90 else 1 if chr(c) in ".!?;:\n" else 32 for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Transducer:
    """A deterministic weighted transducer: (state, symbol) to (state, symbol, weight). Missing arcs copy the symbol and stay."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))


def compose(*machines: Transducer, alphabet: str) -> Transducer:
    """The machine that feeds each machine's output to the next; weights add up. Only reachable states are built."""
    start = tuple(m.start for m in machines)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            out, weight, target = symbol, 0.0, []
            for machine, own in zip(machines, state):
                own, out, extra = machine.step(own, out)
                target.append(own)
                weight += extra
            target = tuple(target)
            arcs[state, symbol] = (target, out, weight)
            if target not in seen:
                seen.add(target)
                todo.append(target)
    return Transducer(start, arcs)


def reported() -> Transducer:
    """After a word of saying, hits up to the end of the clause are reported speech and turn small."""
    arcs = {(0, REPORT): (1, OTHER, 0.0), (1, REPORT): (1, OTHER, 0.0), (0, END): (0, END, 0.0), (1, END): (0, END, 0.0)}
    arcs |= {(1, hit): (1, hit.lower(), 0.0) for hit in (INSULT, THREAT)}
    return Transducer(0, arcs)


def negated(reach: int = 2) -> Transducer:
    """A hit within ``reach`` words after a negation turns small."""
    arcs = {}
    for left in range(reach + 1):
        arcs[left, NEGATION] = (reach, OTHER, 0.0)
        arcs[left, END] = (0, END, 0.0)
        for symbol in (INSULT, THREAT, INSULT.lower(), THREAT.lower(), TARGET, OTHER):
            small = left > 0 and symbol in (INSULT, THREAT)
            arcs[left, symbol] = (max(0, left - 1), symbol.lower() if small else symbol, 0.0)
    return Transducer(0, arcs)


# Shares of a hit's own weight.
PLAIN_HIT, AIMED_HIT, SMALL_HIT, AIMED_THREAT = 1.0, 1.5, 0.25, 1.5


def aimed(reach: int = 4) -> Transducer:
    """Weighs hits: more where a target stands within ``reach`` words on either side. A threat without a target weighs nothing.

    States are (words since a target, words since a hit that has no target yet, class of that hit), so a target that
    follows still adds the difference.
    """
    arcs, far = {}, reach + 1
    for target, hit, kind in product(range(1, far + 1), range(1, far + 1), "IiHh"):
        on = lambda d: min(far, d + 1)
        state = (target, hit, kind)
        arcs[state, END] = ((far, far, "I"), END, 0.0)
        arcs[state, OTHER] = ((on(target), on(hit), kind), OTHER, 0.0)
        gain = {"I": AIMED_HIT - PLAIN_HIT, "i": 0.0, "H": AIMED_THREAT, "h": SMALL_HIT}[kind] if hit <= reach else 0.0
        arcs[state, TARGET] = ((1, far, kind), TARGET, gain)
        for symbol in "IiHh":
            near = target <= reach
            weight = {"I": AIMED_HIT if near else PLAIN_HIT, "i": SMALL_HIT, "H": AIMED_THREAT if near else 0.0, "h": SMALL_HIT if near else 0.0}[symbol]
            arcs[state, symbol] = ((on(target), far if near else 1, symbol), symbol, weight)
    return Transducer((far, far, "I"), arcs)


class Grammar:
    """The composed machine as tables of numbers: next state and weight by (state, class)."""

    ALPHABET = OTHER + INSULT + THREAT + TARGET + NEGATION + REPORT + END

    def __init__(self):
        whole = compose(reported(), negated(), aimed(), alphabet=self.ALPHABET)
        number = {s: i for i, s in enumerate({whole.start: None} | {s: None for s, _ in whole.arcs})}
        self.next = [[0] * len(self.ALPHABET) for _ in number]
        self.weight = [[0.0] * len(self.ALPHABET) for _ in number]
        for (state, symbol), (target, _, weight) in whole.arcs.items():
            at = self.ALPHABET.index(symbol)
            self.next[number[state]][at], self.weight[number[state]][at] = number[target], weight

    def score(self, classes: list[int], weights: list[float]) -> float:
        """Weight of one clause: each arc's weight times that of the hit it belongs to (the one read, or the last one read)."""
        state, total, last = 0, 0.0, 0.0
        for symbol, own in zip(classes, weights):
            last = own or last
            total += self.weight[state][symbol] * last
            state = self.next[state][symbol]
        return total


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


class Words:
    """Words of several texts: text number, clause number, hash of the word and of each of its prefixes."""

    def __init__(self, texts: list[bytes]):
        b = np.frombuffer(b"".join(t + b"\x01" for t in texts) + b" ", np.uint8)
        letter = (b != 32) & (b != 1)
        turn = np.diff(letter.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.count, lengths = len(starts), ends - starts
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
        self.clause = np.cumsum(b == 1)[starts]
        # Polynomial hashes of all prefixes by one running sum: the sum up to a byte, less what came before the word.
        first = np.zeros(len(b), np.int64)
        first[starts] = starts
        place = np.arange(len(b)) - np.maximum.accumulate(first)
        power = np.power(np.uint64(0x100000001B3), np.arange(256, dtype=np.uint64))
        run = np.cumsum(np.where(letter, (b.astype(np.uint64) + np.uint64(1)) * power[place & 255], np.uint64(0)), dtype=np.uint64)
        before = np.where(starts > 0, run[starts - 1], np.uint64(0))
        self.word = _mixed((run[ends - 1] - before) * _MIX + lengths.astype(np.uint64))
        self.prefixes = []  # of each length: which words are longer, and their hashes
        for k in PREFIXES:
            longer = np.flatnonzero(lengths > k)
            self.prefixes.append((longer, _mixed((run[starts[longer] + k - 1] - before[longer]) * _MIX + np.uint64(1000 + k))))

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word numbers and hashes: whole words first, then prefixes."""
        yield np.arange(self.count), self.word
        yield from self.prefixes

    def contexts(self) -> np.ndarray:
        """A hash of each word with the words before and after it in its text."""
        padded = np.concatenate(([np.uint64(1)], self.word, [np.uint64(1)]))
        left, right = padded[:-2].copy(), padded[2:].copy()
        edge = np.flatnonzero(self.text[1:] != self.text[:-1])
        left[edge + 1], right[edge] = np.uint64(1), np.uint64(1)
        return _mixed(_mixed(left * _MIX + self.word) * _MIX + right)


def folded(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_FOLD) if text else b""


def _chunks(column: pa.Array) -> Iterator[list[bytes]]:
    """Folded texts, about CHUNK_BYTES at once; a longer text comes alone."""
    held, size = [], 0
    for value in column:
        text = folded(value.as_py())
        if held and size + len(text) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    hashes, classes = [], []
    for symbol, words in CLASS_WORDS.items():
        own = Words([folded(words)]).word
        hashes.append(own)
        classes.append(np.full(len(own), Grammar.ALPHABET.index(symbol)))
    hashes, classes = np.concatenate(hashes), np.concatenate(classes)
    order = np.argsort(hashes)
    return hashes[order], classes[order]


class Model:
    """Learned insult hashes with weights, the fixed classes, the grammar, and the calibration of its two measures."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, calibration: tuple[float, float, float] = (-3.0, 1.0, 1.0)):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]
        self.fixed, self.classes = _class_table()
        self.grammar, self.calibration = Grammar(), calibration

    def clauses(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Word counts, and of each text the clauses that weigh anything: first word, words, weight."""
        words = Words(texts)
        symbol, weight = np.zeros(words.count, np.int64), np.zeros(words.count)
        known, at = found_in(self.fixed, words.word)
        symbol[known] = self.classes[at[known]]
        weight[symbol == Grammar.ALPHABET.index(THREAT)] = THREAT_WEIGHT
        for own, hashes in words.features():
            known, at = found_in(self.hashes, hashes)
            hit = own[known]
            weight[hit] = np.maximum(np.where(symbol[hit] == Grammar.ALPHABET.index(INSULT), weight[hit], 0.0), self.weights[at[known]])
            symbol[hit] = Grammar.ALPHABET.index(INSULT)
        out: list[list] = [[] for _ in texts]
        sizes = np.bincount(words.text, minlength=len(texts)) if words.count else np.zeros(len(texts), np.int64)
        begin = np.cumsum(sizes) - sizes
        for clause in np.unique(words.clause[weight > 0]).tolist():
            a, b = np.searchsorted(words.clause, [clause, clause + 1])
            value = self.grammar.score(symbol[a:b].tolist(), weight[a:b].tolist())
            if value > 0:
                number = int(words.text[a])
                out[number].append((int(a - begin[number]), int(b - a), value))
        return sizes, out

    def score(self, total: float, most: float) -> float:
        bias, by_total, by_most = self.calibration
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, bias + by_total * math.log1p(total) + by_most * math.log1p(most)))))


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps; no coefficient but the first is negative."""
    used = list(range(x.shape[1]))
    while True:
        own, beta = x[:, used], np.zeros(len(used))
        ridge = np.diag([1e-6] + [0.1] * (len(used) - 1))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ beta, -50, 50)))
            step = np.linalg.solve(own.T @ (own * (w * p * (1 - p))[:, None]) + ridge, own.T @ (w * (y - p)) - ridge @ beta)
            beta += np.clip(step, -3, 3)
        if (beta[1:] >= 0).all():
            out = np.zeros(x.shape[1])
            out[used] = beta
            return out
        used.remove(used[1 + int(beta[1:].argmin())])


def insult_weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds of features by their counts in toxic and clean text; 0 where the evidence is too thin."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    share, both = n_toxic / max(1, n_toxic + n_clean), toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        other = np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0.0) if share < 1 else np.zeros(len(toxic))
        evidence = 2 * (toxic * np.log(toxic / (both * share)) + other)
    return np.where((toxic >= MIN_CONTEXTS) & (ratio >= math.log(MIN_RATIO)) & (evidence >= MIN_EVIDENCE), np.minimum(ratio, MAX_WEIGHT), 0.0)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_texts: int = TOXIC_TEXTS, clean_texts: int = CLEAN_TEXTS) -> Model:
    """Learn insult words and word beginnings, and the calibration, from labelled texts.

    About ``toxic_texts`` texts labelled 1 and ``clean_texts`` labelled 0 are the sample (the documented bound),
    chosen by a digest of the text; equal texts count once, and of texts with the same least five-word hash (near
    copies) one stays. Whole words and beginnings of PREFIXES bytes become insults if they stand between different words at least
    MIN_CONTEXTS times in the toxic sample, are MIN_RATIO times as frequent there, and a likelihood ratio
    of MIN_EVIDENCE says so. A passage that copies share gives its words one context, so it teaches no insult.

    Keys with both labels, null keys, labels and texts teach nothing. Without labels of both kinds nothing is learned: only
    the fixed threats then score. Repeated label rows count once.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y")).where("key IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").select("key", "y")
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").withColumn("digest", F.xxhash64("text"))
    counts = dict(texts.select("key", "digest").join(known, "key").select("y", "digest").distinct().groupBy("y").count().collect())  # two rows
    none = Model(np.empty(0, np.uint64), np.empty(0))
    if len(counts) < 2:
        return none
    share = {y: min(1.0, n / counts[y]) for y, n in ((0, clean_texts), (1, toxic_texts))}
    unit = F.pmod("digest", F.lit(1 << 30)) / float(1 << 30)
    chosen = texts.where(unit < max(share.values())).join(known, "key").where(unit < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for chunk in _chunks(batch.column(1)):
                words = Words(chunk)
                runs = words.word.copy()
                for i in range(1, 5):
                    runs[:-i] = _mixed(runs[:-i] * _MIX + words.word[i:]) if words.count > i else runs[:-i]
                whole = np.full(len(chunk), (1 << 64) - 1, np.uint64)
                inside = np.ones(words.count, bool)
                inside[max(0, words.count - 4) :] = False
                inside[:-4] &= words.text[4:] == words.text[:-4] if words.count > 4 else inside[:-4]
                np.minimum.at(whole, words.text[inside], runs[inside])
                short = np.setdiff1d(np.arange(len(chunk)), words.text[inside])
                whole[short] = [hash_words([chunk[i]])[0] for i in short]
                marks.append(whole)
            values = np.concatenate(marks) if marks else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), batch.column(1)], names=["y", "least", "text"])

    sample = chosen.select("y", "text").mapInArrow(least, "y int, least bigint, text string").groupBy("y", "least").agg(F.min("text").alias("text"))
    sample = staged(sample.select("y", "text"), "toxic-sample")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(batch.column(0)):
                words = Words(chunk)
                contexts = words.contexts()
                pairs = np.concatenate([np.stack([hashes, contexts[own]]) for own, hashes in words.features()], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(row.view(np.int64)) for row in np.ascontiguousarray(pairs)], names=["feature", "context"])

    pairs = sample.where("y = 1").select("text").mapInArrow(met, "feature bigint, context bigint").distinct()
    # No more rows than the bounded sample has words and beginnings, by MIN_CONTEXTS.
    often = pairs.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_CONTEXTS).toPandas()
    hashes = often["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    hashes, toxic = hashes[order], often["n"].to_numpy(np.int64)[order]
    sent = spark.sparkContext.broadcast(hashes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, total = np.zeros(len(sent.value), np.int64), 0
        for batch in batches:
            for chunk in _chunks(batch.column(0)):
                words = Words(chunk)
                total += words.count
                for _, own in words.features():
                    known, at = found_in(sent.value, own)
                    times += np.bincount(at[known], minlength=len(times))
        some = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(times[some], total))], names=["at", "n"])

    def totals(y: int) -> dict[int, int]:
        return dict(sample.where(F.col("y") == y).select("text").mapInArrow(counted, "at bigint, n bigint").groupBy("at").agg(F.sum("n")).collect())  # as many rows as candidates

    seen = totals(0)
    n_toxic = sample.where("y = 1").select("text").mapInArrow(counted, "at bigint, n bigint").where("at = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    clean = np.array([seen.get(i, 0) for i in range(len(hashes))], np.int64)
    weights = insult_weights(toxic, clean, n_toxic, seen.get(-1, 0))
    model = Model(hashes[weights > 0], weights[weights > 0])
    marked = score_texts(sample, model).select("y", F.col("toxicity.total").alias("total"), F.col("toxicity.most").alias("most")).toPandas()  # the bounded sample, three numbers a row
    y = marked["y"].to_numpy(float)
    if y.min() == y.max():
        return none
    x = np.stack([np.ones(len(y)), np.log1p(marked["total"].to_numpy(float)), np.log1p(marked["most"].to_numpy(float))], axis=1)
    by = np.array([counts[0] / max(1, (y == 0).sum()), counts[1] / max(1, (y == 1).sum())])
    w = by[y.astype(int)]
    model.calibration = tuple(float(v) for v in _fit(x, y, w / w.mean()))
    return model


CLAUSE = pa.struct([("first", pa.int64()), ("words", pa.int64()), ("weight", pa.float64())])
RESULT_TYPE = pa.struct([("score", pa.float64()), ("total", pa.float64()), ("most", pa.float64()), ("n_words", pa.int64()), ("clauses", pa.list_(CLAUSE))])
RESULT = "struct<score:double,total:double,most:double,n_words:bigint,clauses:array<struct<first:bigint,words:bigint,weight:double>>>"


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``toxicity``: score, total, most, n_words, clauses.

    Each clause (words between . ! ? ; : and line ends) runs through the composed transducers: hits after a word of
    saying or within two words of a negation weigh a quarter, hits within four words of a target weigh half as much
    again, threats count only with a target. ``clauses`` lists those that weigh anything (first word, words, weight);
    ``total`` and ``most`` are the sum and the largest weight, and ``score`` (0 to 1) is their calibrated chance of label 1.
    One pass without shuffle; the model is of bounded size.

    Null, empty and wordless texts: no clause, the score of a text without hits. Texts of any length are read whole. Repeated
    rows get the same answer. A column called ``toxicity`` stays; the new one is then ``toxicity_1``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def mark(texts: pa.Array) -> pa.Array:
        out = []
        for chunk in _chunks(texts):
            sizes, clauses = sent.value.clauses(chunk)
            for n, found in zip(sizes.tolist(), clauses):
                total, most = sum(c[2] for c in found), max((c[2] for c in found), default=0.0)
                rows = [{"first": a, "words": b, "weight": v} for a, b, v in found]
                out.append({"score": sent.value.score(total, most), "total": total, "most": most, "n_words": n, "clauses": rows})
        return pa.array(out, RESULT_TYPE)

    # Else a filter on the result would run it once more.
    return docs.withColumn(fresh(docs, "toxicity"), mark.asNondeterministic()(F.col(f"`{text}`")))


def is_held_out(key: Column) -> Column:
    """Documents that teach nothing: crc32 of the id as text, mod 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
