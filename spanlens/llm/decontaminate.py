"""Benchmark passages in documents: winnowed fingerprints find candidates, hits are extended to whole windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.common import found_in, fresh, hash_words, raw_texts, row_key, run_hashes, staged

WINDOW = 10
GRAM = 5
BLOCK_WINDOWS = 500_000

# A-Z to lower case, every other ASCII character but 0-9 and a-z to a space.
_FOLD = bytes(c if chr(c).isalnum() and c < 128 and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else c if c >= 128 else 32 for c in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_FOLD).split() if text else []


def winnowed(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest gram hash of each run of ``window`` words; equal runs have equal minima wherever they stand.

    The distinct minima are the fingerprints of the text: any two texts that share ``window`` words share one.
    """
    grams = run_hashes(words, gram)
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = grams[:n].copy()
    for i in range(1, window - gram + 1):
        np.minimum(least, grams[i : i + n], out=least)
    return least


def benchmark_windows(items: DataFrame, item: str, text: str, window: int, gram: int) -> DataFrame:
    """item, length, hash, mark of every window of each item; ``mark`` is its fingerprint (the hash itself where shorter than ``window``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                words = hash_words(plain_words(raw))
                length = min(window, len(words))
                if length == 0:
                    continue
                hashes = run_hashes(words, length)
                marks = winnowed(words, window, gram) if length == window else hashes
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(hashes), pa.string()), pa.array(np.full(len(hashes), length, np.int32)), pa.array(hashes.view(np.int64)), pa.array(marks.view(np.int64))],
                    names=["item", "length", "hash", "mark"],
                )

    chosen = items.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").alias("text"))
    return chosen.mapInArrow(cut, "item string, length int, hash bigint, mark bigint").distinct()


class Windows:
    """One block of benchmark windows in sorted arrays, as sent to the workers."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        self.window, self.gram = window, gram
        hashes = rows["hash"].to_numpy().view(np.uint64)
        lengths = rows["length"].to_numpy()
        names, numbers = np.unique(np.array(rows["item"].to_pylist(), object).astype(str), return_inverse=True) if len(hashes) else (np.empty(0, str), np.empty(0, np.int64))
        self.names = names
        self.by_length = {}
        for length in sorted(set(lengths.tolist())):
            here = lengths == length
            order = np.argsort(hashes[here], kind="stable")
            self.by_length[int(length)] = (hashes[here][order], numbers[here][order])
        marks = rows["mark"].to_numpy().view(np.uint64)[lengths == window]
        self.marks = np.unique(marks)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Which words stand in an occurrence of a window, and the items with such windows."""
        edge = np.zeros(len(words) + 1, np.int32)
        found: set[int] = set()
        for length, (hashes, numbers) in self.by_length.items():
            if len(words) < length:
                continue
            if length == self.window:
                least = winnowed(words, self.window, self.gram)
                turn = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                known, _ = found_in(self.marks, least[turn])
                if not known.any():
                    continue
                ends = np.append(turn[1:], len(least))
                starts = np.concatenate([np.arange(a, b) for a, b in zip(turn[known], ends[known])])
                span = np.stack([words[starts + i] for i in range(length)])
                runs = _column_hashes(span)
            else:
                starts, runs = np.arange(len(words) - length + 1), run_hashes(words, length)
            known, first = found_in(hashes, runs)
            for start in starts[known]:
                edge[start] += 1
                edge[start + length] -= 1
            for at in np.unique(first[known]):
                end = np.searchsorted(hashes, hashes[at], "right")
                found.update(numbers[at:end].tolist())
        return np.cumsum(edge[:-1]) > 0, [str(self.names[i]) for i in found]


def _column_hashes(span: np.ndarray) -> np.ndarray:
    """``run_hashes`` of each column of a matrix of word hashes."""
    out = np.full(span.shape[1], 0x9E3779B97F4A7C15, np.uint64)
    for row in span:
        out ^= row
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


RESULT = "struct<n_words:bigint,n_hit:bigint,hit_starts:array<bigint>,hit_ends:array<bigint>,items:array<string>>"
RESULT_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_starts", pa.list_(pa.int64())), ("hit_ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _scan(block):
    """Arrow UDF: a text against one block of windows."""

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for raw in raw_texts(texts):
            words = hash_words(plain_words(raw))
            hit, items = block.value.hits(words)
            steps = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            out.append({
                "n_words": len(words),
                "n_hit": int(hit.sum()),
                "hit_starts": np.flatnonzero(steps == 1),
                "hit_ends": np.flatnonzero(steps == -1),
                "items": sorted(items, key=str.encode),
            })
        return pa.array(out, RESULT_TYPE)

    # Else a filter on the result would run it once more.
    return scan.asNondeterministic()


def _merged(spans: F.Column) -> F.Column:
    """Sorted (start, end) structs joined where they touch or overlap."""
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with a struct column ``leaks``: n_words, n_hit, hit_starts, hit_ends (word positions), items.

    A word is hit if it stands in an occurrence of a window: ``window`` consecutive words of an item, or all
    of an item that has fewer. Per text the smallest ``gram`` hash of each run of ``window`` words is looked
    up among the fingerprints of the benchmark; runs whose fingerprint is known are extended to the whole
    window and compared. A shared run of ``window`` words has the same minimum on both sides, so none is lost.

    The windows of the benchmark are dealt by hash into blocks of about ``block_windows``, and one block at
    a time is sent to the workers (a few MB), so what is broadcast is bounded whatever the benchmark's size.
    With one block the scan is a single pass without shuffle; with more, each block is a pass over the texts
    that keeps only the rows with hits, and these meet by a digest of key and text.

    Null and empty texts: no words, no hits; such items have no windows. An item with null id counts, under
    the empty name. Repeated rows and items: each row is scanned, items by name once. Empty benchmark: no
    hits. A column called ``leaks`` stays; the new one is then ``leaks_1``.
    """
    context = docs.sparkSession.sparkContext
    windows = staged(benchmark_windows(benchmark, item, item_text, window, gram), "windows")
    n_blocks = max(1, math.ceil(windows.count() / block_windows))
    out, value = fresh(docs, "leaks"), F.col(f"`{text}`")
    blocks = []
    for number in range(n_blocks):
        rows = windows.where(F.pmod("hash", F.lit(n_blocks)) == number).toArrow()
        blocks.append(context.broadcast(Windows(rows, window, gram)))
        if n_blocks == 1:
            return docs.withColumn(out, _scan(blocks[0])(value))
    texts = docs.select(row_key(*docs.columns).alias("key"), value.alias("text"))
    parts = None
    for block in blocks:
        part = texts.select("key", _scan(block)("text").alias("leak"))
        part = part.where(F.col("leak.n_hit") > 0)
        parts = part if parts is None else parts.unionByName(part)
    spans = F.arrays_zip(F.col("leak.hit_starts").alias("start"), F.col("leak.hit_ends").alias("end"))
    parts = parts.groupBy("key").agg(
        _merged(F.flatten(F.collect_set(spans))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("leak.items")))).alias("items"),
    )
    count = F.arrow_udf(lambda texts: pa.array([len(plain_words(raw)) for raw in raw_texts(texts)], pa.int64()), "bigint")
    key, spans, items = (fresh(docs, n) for n in ("__key", "__spans", "__items"))
    parts = parts.withColumnsRenamed({"key": key, "spans": spans, "items": items})
    marked = docs.withColumn(key, row_key(*docs.columns)).join(parts, key, "left")
    none = F.array().cast("array<bigint>")
    leak = F.struct(
        count(value).alias("n_words"),
        F.coalesce(F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.col(f"{spans}.start"), none).alias("hit_starts"),
        F.coalesce(F.col(f"{spans}.end"), none).alias("hit_ends"),
        F.coalesce(items, F.array().cast("array<string>")).alias("items"),
    )
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], leak.alias(out))
