"""Language of words and texts by a linear-chain conditional random field, trained and applied on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.llm.common import found_in, fresh, staged

GRAM_BITS, AFFIX_BITS, LEXICON_SIZE = 15, 14, 20_000
N_GRAMS, N_AFFIXES = 3, 2
GRAMS = 1 << GRAM_BITS
AFFIXES = 1 << AFFIX_BITS
LEXICON_AT = N_GRAMS * GRAMS + N_AFFIXES * AFFIXES
N_FEATURES = LEXICON_AT + LEXICON_SIZE + 1  # the last one: not in the lexicon
CHUNK_BYTES = 200_000
SEGMENT = 128

# ASCII characters that are no letters part words.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MIX = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(37))


def folded(text: str) -> bytes:
    """Lower case, words parted by single bytes 32 wherever no letter stands; empty if there is no letter."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD) if any(map(str.isalpha, text)) else b""


class Words:
    """The words of a buffer of folded text and the features of each."""

    def __init__(self, buffer: bytes, lexicon: np.ndarray):
        b = np.frombuffer(b"  " + buffer + b"   ", np.uint8)
        letter = b != 32
        turn = np.diff(letter.astype(np.int8))
        self.starts = np.flatnonzero(turn == 1) + 1
        self.ends = np.flatnonzero(turn == -1) + 1
        self.count = len(self.starts)
        places = np.flatnonzero(letter)
        lengths = self.ends - self.starts
        self.lengths = lengths
        self.first = np.cumsum(lengths) - lengths  # of each word, among the letters
        w = b.astype(np.int64)
        before, here, after = w[places - 1], w[places], w[places + 1]
        second = np.where(after == 32, 32, w[places + 2])
        three = before << 16 | here << 8 | after
        four = three << 8 | second
        self.grams = np.stack([
            (here * 257 + after) * 40503 >> 3 & GRAMS - 1,
            GRAMS + ((three * 2654435761 >> 13) & GRAMS - 1),
            2 * GRAMS + ((four * 2654435761 >> 17) & GRAMS - 1),
        ])
        two, long = lengths > 1, lengths > 2
        head = w[self.starts] << 16 | np.where(two, w[self.starts + 1], 0) << 8 | np.where(long, w[self.starts + 2], 0)
        tail = np.where(long, w[self.ends - 3], 0) << 16 | np.where(two, w[self.ends - 2], 0) << 8 | w[self.ends - 1]
        hashes = self._hashes(b, places, lengths)
        known, at = found_in(lexicon, hashes)
        self.hashes = hashes
        self.affixes = np.stack([
            N_GRAMS * GRAMS + ((head * 2654435761 >> 15) & AFFIXES - 1),
            N_GRAMS * GRAMS + AFFIXES + ((tail * 2654435761 >> 15) & AFFIXES - 1),
            LEXICON_AT + np.where(known, at, LEXICON_SIZE),
        ])

    def _hashes(self, b: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not self.count:
            return np.empty(0, np.uint64)
        order = places - np.repeat(self.starts, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C13, np.uint64))
        return np.add.reduceat(_MIX[b[places]] * powers[order], self.first)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """The score of each label for each word: the sum of its features' weights."""
        if not self.count:
            return np.zeros((0, weights.shape[1]), np.float32)
        letters = weights[self.grams[0]]
        for k in range(1, N_GRAMS):
            letters += weights[self.grams[k]]
        out = np.add.reduceat(letters, self.first, axis=0)
        for row in self.affixes:
            out += weights[row]
        return out

    def gradient(self, d: np.ndarray, n: int) -> np.ndarray:
        """The sum over words of d (word, label) at each feature."""
        letters = np.repeat(d, self.lengths, axis=0)
        out = np.empty((n, d.shape[1]), np.float32)
        for k in range(d.shape[1]):
            out[:, k] = np.bincount(self.affixes.ravel(), np.tile(d[:, k], len(self.affixes)), n)
            out[:, k] += np.bincount(self.grams.ravel(), np.tile(letters[:, k], N_GRAMS), n)
        return out


def forward_backward(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward values and exp(scores) of sequences laid end to end.

    Sequences are cut into segments. The product of a segment's transfer matrices tells what it does to any
    incoming vector, so segments run side by side, a short scan over them gives each one its incoming
    vectors, and the values inside follow. The result is that of the plain recursion; the number of steps is
    the segment length plus the number of segments of the longest sequence.
    """
    n, labels = scores.shape
    e = np.exp((scores - scores.max(axis=1, keepdims=True)).clip(-60, 0)).astype(np.float64)
    a = np.exp(transitions.astype(np.float64))
    per = -(-lengths // SEGMENT)
    doc = np.repeat(np.arange(len(lengths)), per)
    ordinal = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(lengths) - lengths, per) + ordinal * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(lengths, per) - ordinal * SEGMENT)
    order = np.argsort(-size, kind="stable")
    begin, size, ordinal, doc = begin[order], size[order], ordinal[order], doc[order]
    longest = int(size.max(initial=0))
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]
    several = bool((per > 1).any())
    enter = np.full((len(doc), labels), 1.0 / labels)
    leave = np.ones((len(doc), labels))
    if several:
        m = np.broadcast_to(np.eye(labels), (len(doc), labels, labels)).copy()
        for t, k in enumerate(active):
            step = (m[:k] @ a) * e[begin[:k] + t][:, None, :]
            m[:k] = step / step.sum(axis=(1, 2), keepdims=True)
        place = np.argsort(ordinal, kind="stable")
        groups = np.split(place, np.cumsum(np.bincount(ordinal))[:-1])
        slot = np.full(len(lengths), -1)
        for before, here in zip(groups, groups[1:]):
            slot[doc[before]] = before
            p = slot[doc[here]]
            v = np.einsum("ij,ijk->ik", enter[p], m[p])
            enter[here] = v / v.sum(axis=1, keepdims=True)
        for before, here in zip(groups[-2::-1], groups[:0:-1]):
            slot[doc[before]] = before
            p = slot[doc[here]]
            v = np.einsum("ijk,ik->ij", m[here], leave[here])
            leave[p] = v / v.sum(axis=1, keepdims=True)
    alpha, beta = np.empty((n, labels)), np.empty((n, labels))
    v = enter
    for t, k in enumerate(active):
        at = begin[:k] + t
        v = (v[:k] @ a) * e[at]
        v /= v.sum(axis=1, keepdims=True)
        alpha[at] = v
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        beta[at] = leave[:k]
        back = (e[at] * leave[:k]) @ a.T
        leave[:k] = back / back.sum(axis=1, keepdims=True)
    return alpha, beta, e


def marginals(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True)


class Model:
    """Labels, the lexicon (sorted word hashes), feature weights and transition scores."""

    def __init__(self, labels: list[str], lexicon: np.ndarray, weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.lexicon, self.weights, self.transitions = labels, lexicon, weights, transitions

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of the words of all texts, end to end, and the number of words of each text."""
        scores, counts, at = [], [], 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK_BYTES):
                held += len(texts[end]) + 1
                end += 1
            words = Words(b" ".join(texts[at:end]), self.lexicon)
            scores.append(words.emissions(self.weights))
            edges = np.cumsum([len(x) + 1 for x in texts[at:end]]) + 2
            counts.append(np.diff(np.concatenate(([0], np.searchsorted(words.starts, edges)))))
            at = end
        lengths = np.concatenate(counts) if counts else np.empty(0, np.int64)
        scores = np.concatenate(scores) if scores else np.zeros((0, len(self.labels)))
        if not len(scores) or not self.labels:
            return scores, lengths
        alpha, beta, _ = forward_backward(scores, self.transitions, lengths)
        return marginals(alpha, beta), lengths


def _sequences(texts: list[bytes], labels: list[int], rng: np.random.Generator, piece: int = 40, join: int = 3) -> list[tuple[bytes, np.ndarray]]:
    """Code-switched training text: pieces of ``piece`` words of any texts, dealt at random and joined by threes."""
    pieces = []
    for text, label in zip(texts, labels):
        words = text.split()
        pieces += [(b" ".join(words[i : i + piece]), label, len(words[i : i + piece])) for i in range(0, len(words), piece)]
    order = rng.permutation(len(pieces))
    out = []
    for i in range(0, len(order), join):
        chosen = [pieces[k] for k in order[i : i + join]]
        out.append((b" ".join(p[0] for p in chosen), np.concatenate([np.full(p[2], p[1]) for p in chosen])))
    return out


def _epoch(model: Model, sequences: list[tuple[bytes, np.ndarray]], rate: float, batch: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """One pass of adaptive gradient steps on the conditional log likelihood; new weights and transitions."""
    weights, transitions = model.weights.copy(), model.transitions.astype(np.float32)
    seen, seen_t = np.full_like(weights, 1e-2), np.full_like(transitions, 1e-2)
    n = len(model.labels)
    for at in range(0, len(sequences), batch):
        part = sequences[at : at + batch]
        words = Words(b" ".join(s[0] for s in part), model.lexicon)
        gold, lengths = np.concatenate([s[1] for s in part]), np.array([len(s[1]) for s in part])
        alpha, beta, e = forward_backward(words.emissions(weights), transitions, lengths)
        d = -marginals(alpha, beta)
        d[np.arange(len(gold)), gold] += 1
        inner = np.ones(len(gold), bool)
        inner[np.cumsum(lengths) - lengths] = False
        now = np.flatnonzero(inner)
        pair = alpha[now - 1][:, :, None] * np.exp(transitions)[None] * (e[now] * beta[now])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        step_t = np.bincount(gold[now - 1] * n + gold[now], minlength=n * n).reshape(n, n) - pair.sum(axis=0)
        step = words.gradient(d, len(weights))
        seen += step * step
        seen_t += (step_t * step_t).astype(np.float32)
        weights += rate * step / np.sqrt(seen)
        transitions += (rate * step_t / np.sqrt(seen_t)).astype(np.float32)
    return weights, transitions


def _learner(start, turn: int, rate: float):
    """A function that trains one shard from the common weights."""

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["digest", "label"])
        shard = int(part["shard"].iloc[0])
        texts = [folded(t) for t in part["text"]]
        kept = [i for i, t in enumerate(texts) if t.split()]
        sequences = _sequences([texts[i] for i in kept], [int(part["label"].iloc[i]) for i in kept], np.random.default_rng(1000 * turn + shard))
        weights, transitions = _epoch(start.value, sequences, rate)
        return pd.DataFrame({"shard": [shard], "n": [len(sequences)], "weights": [weights.tobytes()], "transitions": [transitions.tobytes()]})

    return learn


def train(labelled: DataFrame, text: str = "text", label: str = "lang", per_label: int = 500, rounds: int = 3, shards: int = 6, rate: float = 0.3) -> Model:
    """Train on about ``per_label`` whole texts of each label (the documented bound of the sample).

    The sample is chosen by a digest of the text, so reruns agree, and copies of a text under one label count once; it is staged in ``shards`` parts. Each
    round every shard starts from the common weights, makes one pass over its code-switched sequences, and
    the weights are averaged. The lexicon holds the words seen most often in the sample, at least three times.
    Rows with null label or text, or without a letter, teach nothing. Without any labelled row the model has no labels.
    """
    spark = labelled.sparkSession
    labelled = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    # A text teaches a label once, however many copies there are; only digests are shuffled for it.
    counts = {r["label"]: r["n"] for r in labelled.select("label", F.md5("text").alias("digest")).distinct().groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per language
    labels = sorted(counts)
    number = {x: i for i, x in enumerate(labels)}
    if not labels:
        return Model([], np.empty(0, np.uint64), np.zeros((N_FEATURES, 0), np.float32), np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(v) for x in labels for v in (x, min(1.0, per_label / counts[x]))])
    digest = F.md5("text")
    unit = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)
    rank = F.create_map(*[F.lit(v) for x in labels for v in (x, number[x])])
    sample = labelled.where(unit < share[F.col("label")]).select("text", rank[F.col("label")].alias("label"), digest.alias("digest")).dropDuplicates(["label", "digest"])
    sample = staged(sample.repartition(shards, "digest").sortWithinPartitions("digest", "label"), "sample")
    shard = F.pmod(F.conv(F.substring("digest", 9, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(b" ".join(folded(t) for t in batch.column(0).to_pylist()), np.empty(0, np.uint64))
            values, n = np.unique(words.hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    seen = sample.select("text").mapInArrow(spell, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = seen.where("n >= 3").orderBy(F.desc("n"), "word").limit(LEXICON_SIZE).select("word").toPandas()
    lexicon = np.sort(top["word"].to_numpy(np.int64).view(np.uint64))
    model = Model(labels, lexicon, np.zeros((N_FEATURES, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32))
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(model)

        parts = sample.withColumn("shard", shard).groupBy("shard").applyInPandas(_learner(start, turn, rate / (1 + turn)), "shard int, n bigint, weights binary, transitions binary").collect()
        parts = sorted((p for p in parts if p["n"]), key=lambda p: p["shard"])  # as many rows as shards
        if not parts:
            return model
        share_of = np.array([p["n"] for p in parts], float) / sum(p["n"] for p in parts)
        weights = sum(s * np.frombuffer(p["weights"], np.float32) for s, p in zip(share_of, parts)).reshape(model.weights.shape)
        transitions = sum(s * np.frombuffer(p["transitions"], np.float32) for s, p in zip(share_of, parts)).reshape(model.transitions.shape)
        model = Model(labels, lexicon, weights.astype(np.float32), transitions.astype(np.float32))
    return model


RUN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
RESULT_TYPE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("certainty", pa.float64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN))])
RESULT = "struct<lang_pred:string,score:double,certainty:double,n_words:bigint,runs:array<struct<start:bigint,end:bigint,lang:string>>>"


def label_texts(docs: DataFrame, model: Model, text: str = "text", with_runs: bool = False, batch_bytes: int = 1_000_000) -> DataFrame:
    """``docs`` with a struct column ``language``: lang_pred, score, certainty, n_words, runs.

    Each word gets the posterior of each language given the whole text, by forward-backward. ``lang_pred`` is
    the language with the largest mean over the words and ``score`` that mean; ``certainty`` is the mean of each word's
    highest posterior, so a text that changes between known languages is certain though none of them rules it. With ``with_runs``, ``runs`` lists
    the maximal runs of words (start, end exclusive) by their most probable language; else it is null. One
    pass without shuffle; only the text reaches the model. The model has a fixed size (a few MB).

    Null, empty and letterless texts (digits, number signs such as "½") are ``und`` with score and certainty 0. Texts of any length are labelled whole. A model without labels: ``und``. Ties go to the
    language first by code point. Repeated rows each get the same answer. A column called ``language`` stays;
    the new one is then ``language_1``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(texts: list[bytes]) -> list[dict]:
        m = sent.value
        post, lengths = m.posteriors(texts)
        out, at = [], 0
        for n in lengths.tolist():
            if not n or not m.labels:
                out.append({"lang_pred": "und", "score": 0.0, "certainty": 0.0, "n_words": n, "runs": [] if with_runs else None})
                continue
            own = post[at : at + n]
            mean, runs = own.mean(axis=0), None
            best = int(mean.argmax())
            if with_runs:
                tags = own.argmax(axis=1)
                cuts = np.flatnonzero(np.concatenate(([True], tags[1:] != tags[:-1], [True])))
                runs = [{"start": int(a), "end": int(b), "lang": m.labels[tags[a]]} for a, b in zip(cuts, cuts[1:])]
            out.append({"lang_pred": m.labels[best], "score": float(min(1.0, mean[best])), "certainty": float(min(1.0, own.max(axis=1).mean())), "n_words": n, "runs": runs})
            at += n
        return out

    @F.arrow_udf(RESULT)
    def tag(texts: pa.Array) -> pa.Array:
        out, held, size = [], [], 0
        for value in texts:
            held.append(folded(value.as_py() or ""))
            size += len(held[-1])
            if size >= batch_bytes:
                out += label(held)
                held, size = [], 0
        return pa.array(out + label(held), RESULT_TYPE)

    # Else a filter on the result would run it once more.
    return docs.withColumn(fresh(docs, "language"), tag.asNondeterministic()(F.col(f"`{text}`")))


def is_held_out(key: Column) -> Column:
    """Documents that neither train nor tune: crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
