"""Language-model scores from log-frequency Bloom filters of quantised n-gram counts, and exact unigram scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.llm.common import found_in, hash_words, raw_texts, space_words, staged

END, BEGIN = np.uint64(0x5DEECE66D1234567), np.uint64(0xA24BAED4963EE407)
CHUNK_TOKENS = 600_000
BUCKET_BYTES = 8_000_000
WRITE_BUCKETS = 16
HEAVY = 1 << 17
PROBES = 4
BASE = 1.5
MIX = 0.2
KEY_BITS = 48  # of a key's 64 bits; the bucket number repeats the top ones


def token_hashes(raw: bytes | None) -> np.ndarray:
    """The words of a text, then one end token."""
    return np.append(hash_words(space_words(raw)), END)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = first * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(31)
    out += second
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their tokens laid end to end and the number of tokens of each; the text is the last column."""
    for batch in batches:
        held, start, size = [], 0, 0
        for i, raw in enumerate(raw_texts(batch.column(batch.num_columns - 1))):
            held.append(token_hashes(raw))
            size += len(held[-1])
            if size >= CHUNK_TOKENS:
                yield batch.slice(start, i + 1 - start), np.concatenate(held), np.array([len(h) for h in held])
                held, start, size = [], i + 1, 0
        if held:
            yield batch.slice(start), np.concatenate(held), np.array([len(h) for h in held])


def previous(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each; the begin mark before the first of a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(lengths) - lengths] = BEGIN
    return out


# Packed columns: keys as 48 low bits (the bucket holds the high ones), counts as unsigned numbers of 4 bytes.
def pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BITS // 8)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, : KEY_BITS // 8] = part
    return out.view("<u8").ravel()


def bucket_cuts(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where each bucket starts in sorted keys; a bucket is a range of the top bits."""
    if n_buckets == 1:
        return np.array([0, len(keys)])
    edges = np.arange(1, n_buckets, dtype=np.uint64) << np.uint64(64 - int(math.log2(n_buckets)))
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def squeeze(values: np.ndarray) -> bytes:
    """Numbers laid out byte by byte (all first bytes, all second ones, …) and compressed, their number in front."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(raw: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(raw[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def counted(training: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, packed keys and counts of words: exact totals over all training texts.

    A task sums up each chunk before the shuffle, so a hot word leaves a chunk once; buckets are ranges of
    hashes and their number follows the input, so one holds a few million entries at any size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in chunks(batches):
            values, n = np.unique(tokens, return_counts=True)
            cuts = bucket_cuts(values, n_buckets)
            rows = []
            for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if lo < hi:
                    v, c = values[lo:hi], n[lo:hi]
                    rows.append({"bucket": b, "ones": pack_keys(v[c == 1]), "many": pack_keys(v[c > 1]), "counts": c[c > 1].astype("<u4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("ones", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())]))

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        ones = unpack_keys(b"".join(part["ones"]))
        many = unpack_keys(b"".join(part["many"]))
        n = np.frombuffer(b"".join(part["counts"]), "<u4").astype(np.int64)
        keys, counts = summed(np.concatenate([ones, many]), np.concatenate([np.ones(len(ones), np.int64), n]))
        return pd.DataFrame({"bucket": [int(part["bucket"].iloc[0])], "total": [int(counts.sum())], "distinct": [len(keys)], "keys": [pack_keys(keys)], "counts": [counts.astype("<i8").tobytes()]})

    packed = training.select("text").mapInArrow(count, "bucket int, ones binary, many binary, counts binary")
    merged = packed.groupBy("bucket").applyInPandas(merge, "bucket int, total bigint, distinct bigint, keys binary, counts binary")
    # A task merges and writes WRITE_BUCKETS buckets: about 128 MB of text each.
    return staged(merged.coalesce(max(1, n_buckets // WRITE_BUCKETS)), "words")


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 + floor(log of the count to BASE)."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def level_value(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range on the log scale; level 1 is 1, level 0 none."""
    middle = np.maximum(1.0, BASE ** (levels - 0.5))
    return np.where(levels <= 0, 0.0, np.where(levels == 1, 1.0, middle))


class LogFilter:
    """Bits in which an n-gram of level q stands as the members (n-gram, 1) to (n-gram, q); blocks are ranges of hashes.

    A count is read back by asking for (n-gram, 1), (n-gram, 2), … until one is missing. Answers are never
    below the stored level; one above it needs a false positive.
    """

    def __init__(self, bits: int, n_blocks: int, data: np.ndarray | None = None):
        self.bits, self.n_blocks = bits, n_blocks
        self.block_bits = bits // n_blocks
        self.data = data

    @staticmethod
    def bits_for(members: int) -> int:
        """A power of two at which ``members`` fill half of the bits at most."""
        return 1 << max(10, math.ceil(math.log2(max(1.0, PROBES * members / math.log(2)))))

    @classmethod
    def of(cls, keys: np.ndarray, levels: np.ndarray) -> LogFilter:
        """One block that holds all of ``keys``, however many there are."""
        model = cls(cls.bits_for(int(levels.sum())), 1)
        model.data = np.packbits(model.filled(keys, levels), bitorder="little")
        return model

    def filled(self, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """The bits of one block with the members of its keys."""
        block = np.zeros(self.block_bits, bool)
        for member in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= member], levels[levels >= member]
            for probe in range(PROBES):
                block[self.places(keys, member, probe).astype(np.int64)] = True
        return block

    def places(self, keys: np.ndarray, member: int, probe: int) -> np.ndarray:
        """The bit inside the key's block that a member's probe looks at."""
        x = keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64((member * PROBES + probe + 1) * 0xA0761D6478BD642F % 2**64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x & np.uint64(self.block_bits - 1)

    def block(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - int(math.log2(self.n_blocks))) if self.n_blocks > 1 else np.zeros(len(keys), np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        live = np.arange(len(keys))
        member = 1
        while len(live):
            at = keys[live]
            base = self.block(at) * np.uint64(self.block_bits)
            for probe in range(PROBES):
                bit = base + self.places(at, member, probe)
                held = (self.data[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, at, base = live[held], at[held], base[held]
            out[live] = member
            member += 1
        return out


def build_filter(grams: DataFrame, max_bits: int, n_buckets: int) -> LogFilter:
    """The filter of all counted words in one piece, built bucket by bucket in tasks and sent to the driver as bits.

    For tables whose filter fits ``max_bits``; a larger one is refused, nothing is left out of it. ``score`` has no
    such bound: it builds and asks one block in each bucket.
    """

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"n": [sum(int(level(np.frombuffer(n, "<i8")).sum()) for n in df["counts"])]})

    members = grams.select("counts").mapInPandas(size, "n bigint").agg(F.sum("n")).first()[0] or 0
    bits = LogFilter.bits_for(members)
    if bits > max_bits:
        raise ValueError(f"the filter takes {bits} bits, more than {max_bits}")
    n_blocks = min(n_buckets, bits // 1024)
    model = LogFilter(bits, n_blocks)
    shift = int(math.log2(n_buckets))
    per = n_buckets // n_blocks

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(model.block_bits, bool)
        for bucket, raw, n in zip(part["bucket"], part["keys"], part["counts"]):
            block |= model.filled(gram_keys(unpack_keys(raw), int(bucket), shift, 1), level(np.frombuffer(n, "<i8")))
        return pd.DataFrame({"block": [int(part["bucket"].iloc[0]) // per], "bits": [np.packbits(block, bitorder="little").tobytes()]})

    spread = grams.withColumn("block", F.expr(f"bucket div {per}"))
    blocks = spread.groupBy("block").applyInPandas(fill, "block int, bits binary").collect()  # max_bits / 8 bytes at most
    data = np.zeros(bits // 8, np.uint8)
    width = model.block_bits // 8
    for row in blocks:
        data[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    model.data = data
    return model


def gram_keys(low: np.ndarray, bucket: int, shift: int, kind: int) -> np.ndarray:
    """The key under which a stored n-gram is asked for: bucket bits on top, then the packed low bits, the kind mixed in."""
    top = np.uint64((bucket << (64 - shift)) & (2**64 - 1)) if shift else np.uint64(0)
    inner = low ^ np.uint64(0x5BD1E995 * kind)
    return top | (inner & np.uint64((1 << min(KEY_BITS, 64 - shift)) - 1))


def asked_keys(keys: np.ndarray, shift: int, kind: int) -> np.ndarray:
    low = keys & np.uint64((1 << KEY_BITS) - 1)
    top = (keys >> np.uint64(64 - shift)) << np.uint64(64 - shift) if shift else np.zeros(len(keys), np.uint64)
    inner = low ^ np.uint64(0x5BD1E995 * kind)
    return top | (inner & np.uint64((1 << min(KEY_BITS, 64 - shift)) - 1))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def is_held_out(key: Column) -> Column:
    """crc32 of the id as text, mod 7, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pair_levels(part: pd.DataFrame, shift: int) -> list[bytes]:
    """The level of each asked pair of each chunk (one byte a pair), from a filter of all training pairs of one bucket.

    Rows have packed keys, each once a chunk, and how often training texts of the chunk have it: one byte, 255 for
    a count that stands in ``over``. A pair that only held-out texts have is asked for but not stored.
    """
    keys = [unpack_keys(raw) for raw in part["keys"]]
    counts = np.frombuffer(b"".join(part["counts"]), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(b"".join(part["over"]), "<u4")
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, counts, len(distinct)).astype(np.int64)
    distinct = gram_keys(distinct, int(part["bucket"].iloc[0]), shift, 2)
    stored = total > 0
    levels = LogFilter.of(distinct[stored], level(total[stored])).levels(distinct).astype(np.uint8)[at]
    return [x.tobytes() for x in np.split(levels, np.cumsum([len(k) for k in keys])[:-1])]


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each document.

    Training texts are those not held out. ``score`` sums log10 of MIX * c(v, w) / c(v) + (1 - MIX) * (c(w) + 1)
    / (N + V + 1), with quantised counts; a text starts after a begin mark and ends with the end token.
    ``base_score`` uses exact counts of words alone.

    Words are counted first. Words that make up at least N / HEAVY of all tokens (at most HEAVY of them) are
    sent along; all others, and all pairs, meet their counts on hash buckets: each chunk of texts sends its
    distinct keys once, a bucket counts the pairs of the training texts, builds the filter block that holds
    them, and answers every chunk from it. Blocks grow in number with the input, not in size, and nothing is
    left out of them. The answers meet the chunk's tokens, which travel as numbers of its distinct words.

    Words are told apart by 64-bit hashes (stored with a bucket number and 48 bits). Null or empty text: the
    end token alone. Null key: trains, not held out. Repeated rows: each trains and each gets its scores. No
    rows: no rows. Nothing to train on: all counts are 0. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("key"), held_out.alias("held"), F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = 1 << max(4, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    shift = int(math.log2(n_buckets))
    words = counted(rows.where(~F.col("held")), n_buckets)
    totals = words.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    n_train, n_distinct = totals["n"] or 0, totals["v"] or 0
    least = max(1, math.ceil(n_train / HEAVY))

    def heavy(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in part:
            for bucket, raw, n in zip(df["bucket"], df["keys"], df["counts"]):
                c = np.frombuffer(n, "<i8")
                keep = c >= least
                yield pd.DataFrame({"k": gram_keys(unpack_keys(raw)[keep], int(bucket), shift, 0).view(np.int64), "c": c[keep]})

    top = words.select("bucket", "keys", "counts").mapInPandas(heavy, "k bigint, c bigint").toPandas()  # HEAVY rows at most
    top_keys = top["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(top_keys)
    sent = spark.sparkContext.broadcast((top_keys[order], top["c"].to_numpy(np.int64)[order]))
    norm = float(n_train + n_distinct + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_keys = sent.value[0]
        task, number = TaskContext.get().partitionId(), 0
        for batch, tokens, lengths in chunks(batches):
            name = (task << 32) + number
            number += 1
            values, inverse = np.unique(tokens, return_inverse=True)
            docs_out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths.astype(np.int64))], names=["key", "held", "n_tokens"])
            blank = {"counts": b"", "over": b""}
            out = [{"bucket": -1 - name % n_buckets, "kind": 0, "chunk": name, "keys": _ipc(docs_out), "counts": squeeze(values), "over": squeeze(inverse.astype("<u4"))}]
            rare = values[~found_in(top_keys, asked_keys(values, shift, 0))[0]]
            cuts = bucket_cuts(rare, n_buckets)
            out += [{"bucket": b, "kind": 1, "chunk": name, "keys": pack_keys(rare[lo:hi])} | blank for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
            pairs, at = np.unique(pair_hashes(previous(tokens, lengths), tokens), return_inverse=True)
            trains = np.repeat(~np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool), lengths)
            n = np.bincount(at[trains], minlength=len(pairs))
            cuts = bucket_cuts(pairs, n_buckets)
            for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if lo < hi:
                    c = n[lo:hi]
                    out.append({"bucket": b, "kind": 2, "chunk": name, "keys": pack_keys(pairs[lo:hi]), "counts": np.minimum(c, 255).astype(np.uint8).tobytes(), "over": c[c >= 255].astype("<u4").tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("over", pa.binary())]))

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The tokens of chunks as they came; exact counts of asked words and levels of asked pairs in the order asked."""
        tokens, asked, pairs = (left[left["kind"] == k] for k in range(3))
        out = list(zip(tokens["chunk"], tokens["bucket"], tokens["kind"], tokens["keys"], tokens["counts"], tokens["over"]))
        keys = unpack_keys(right["keys"].iloc[0]) if len(right) else np.empty(0, np.uint64)
        counts = np.frombuffer(right["counts"].iloc[0], "<i8") if len(right) else np.empty(0, np.int64)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        for chunk, bucket, raw in zip(asked["chunk"], asked["bucket"], asked["keys"]):
            known, at = found_in(keys, unpack_keys(raw))
            out.append((chunk, bucket, 1, squeeze(np.where(known, counts[at] if len(counts) else 0, 0).astype("<i8")), b"", b""))
        if len(pairs):
            out += [(chunk, bucket, 2, raw, b"", b"") for chunk, bucket, raw in zip(pairs["chunk"], pairs["bucket"], pair_levels(pairs, shift))]
        return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "keys", "counts", "over"], dtype=None if out else object)

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        top_keys, top_counts = sent.value
        part = part.sort_values("bucket")
        own = part[part["kind"] == 0].iloc[0]
        df = pa.ipc.open_stream(own["keys"]).read_all().to_pandas(integer_object_nulls=True)
        values, inverse = unsqueeze(own["counts"], "<u8"), unsqueeze(own["over"], "<u4")
        lengths = df["n_tokens"].to_numpy()
        owner = np.repeat(np.arange(len(lengths)), lengths)
        known, at = found_in(top_keys, asked_keys(values, shift, 0))
        exact = np.where(known, top_counts[at] if len(top_counts) else 0, 0)
        if not known.all():
            exact[~known] = np.concatenate([unsqueeze(raw, "<i8") for raw in part.loc[part["kind"] == 1, "keys"]])
        df["n_known"] = np.bincount(owner, (exact > 0)[inverse], len(lengths)).astype(np.int64)
        df["base"] = np.bincount(owner, np.log10(exact + 1.0)[inverse], len(lengths)) - lengths * math.log10(norm)
        c_word = level_value(np.where(exact > 0, level(exact), 0))
        tokens = values[inverse]
        _, at = np.unique(pair_hashes(previous(tokens, lengths), tokens), return_inverse=True)
        c_pair = level_value(np.frombuffer(b"".join(part.loc[part["kind"] == 2, "keys"]), np.uint8).astype(np.int64))[at]
        lower = (c_word[inverse] + 1) / norm
        # As many texts begin as end.
        first = np.cumsum(lengths) - lengths
        c_before = np.roll(c_word[inverse], 1)
        c_before[first] = c_word[np.searchsorted(values, END)]
        seen = c_before > 0
        ratio = np.minimum(1.0, c_pair / np.where(seen, c_before, 1.0))
        df["score"] = np.bincount(owner, np.log10(np.where(seen, MIX * ratio + (1 - MIX) * lower, lower)), len(lengths))
        return df[["key", "held", "n_tokens", "n_known", "base", "score"]]

    kind = rows.schema["key"].dataType.simpleString()
    packed = rows.mapInArrow(scan, "bucket int, kind int, chunk bigint, keys binary, counts binary, over binary")
    looked = packed.groupBy("bucket").cogroup(words.select("bucket", "keys", "counts").groupBy("bucket"))
    looked = looked.applyInPandas(look_up, "chunk bigint, bucket int, kind int, keys binary, counts binary, over binary")
    final = looked.groupBy("chunk").applyInPandas(gather, f"key {kind}, held boolean, n_tokens bigint, n_known bigint, base double, score double")
    return final.select(
        F.col("key").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )
