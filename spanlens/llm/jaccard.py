"""Documents whose sets of word n-grams overlap: a size-aware join that enumerates subsets of small sets and scans lists for large ones."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.llm.common import found_in, hash_words, raw_texts, run_hashes, space_words, staged
from spanlens.llm.components import components

SMALL_SET_MAX = 30  # largest size for which the boundary may be put; small sets are carried whole up to it
HOT_LIST = 16
HOT_HASHES = 1_000_000
SHORT_LIST = 32
BLOCK_SETS = 1_024
BLOCK_ELEMENTS = 400_000
COLUMNS = 2_048
FILTER_BITS = 1 << 26
FILTER_PROBES = 3


def shingle_set(raw: bytes | None, length: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``length`` words; of all words where there are fewer; empty without words."""
    words = hash_words(space_words(raw))
    return np.unique(run_hashes(words, min(length, len(words)))) if len(words) else np.empty(0, np.uint64)


def needed(n: int, m: int, percent: int) -> int:
    """The smallest intersection of sets of n and m elements that links them."""
    return -(-percent * (n + m) // (100 + percent))


def head_size(n: int, percent: int) -> int:
    """How many elements, in one common order, two linked sets cannot both have without sharing one."""
    return n - -(-percent * n // 100) + 1


def class_number(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def signature(elements: np.ndarray) -> bytes:
    """How many elements fall into each of 2^b equal ranges of hashes, about four in each, as bytes."""
    bits = max(3, math.ceil(math.log2(max(1, len(elements)) / 4)))
    return np.minimum(np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(a: bytes, n: int, b: bytes, m: int, percent: int) -> bool:
    """False only if the signatures prove that too many elements differ: ranges that differ by d hold d unshared elements."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if x.max() == 255 or y.max() == 255:
        return True
    k = min(len(x), len(y))
    differ = np.abs(x.reshape(k, -1).sum(axis=1) - y.reshape(k, -1).sum(axis=1)).sum()
    return bool(n + m - 2 * needed(n, m, percent) >= differ)


SETS = "struct<n:bigint,class:bigint,head:array<bigint>,sig:binary>"
SETS_TYPE = pa.struct([("n", pa.int64()), ("class", pa.int64()), ("head", pa.list_(pa.int64())), ("sig", pa.binary())])


def _sets(length: int, percent: int):
    """Arrow UDF: size, class number, head (a small set whole) and signature of a text's set."""

    @F.arrow_udf(SETS)
    def sets(texts: pa.Array) -> pa.Array:
        out = []
        for raw in raw_texts(texts):
            s = shingle_set(raw, length)
            n = len(s)
            head = s[: n if n <= SMALL_SET_MAX else head_size(n, percent)]
            out.append({"n": n, "class": class_number(s), "head": head.view(np.int64), "sig": signature(s)} if n else {"n": 0, "class": None, "head": None, "sig": None})
        return pa.array(out, SETS_TYPE)

    return sets


def _cool_heads(length: int, percent: int, hot):
    """Class, size and head with frequent elements last, of the sets whose plain head holds a frequent one."""
    schema = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("head", pa.list_(pa.int64()))])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, out = [], [], []
            for raw in raw_texts(batch.column(0)):
                s = shingle_set(raw, length)
                p = head_size(len(s), percent) if len(s) else 0
                if found_in(hot.value, s[:p])[0].any():
                    often = found_in(hot.value, s)[0]
                    names.append(class_number(s))
                    sizes.append(len(s))
                    out.append(np.concatenate([s[~often], s[often]])[:p].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], schema=schema)

    return heads


def _is_cool(hot):
    """Arrow UDF: whether a head holds no frequent element."""

    @F.arrow_udf("boolean")
    def cool(heads: pa.Array) -> pa.Array:
        return pa.array([not found_in(hot.value, row.values.to_numpy().view(np.uint64))[0].any() for row in heads], pa.bool_())

    return cool


def subset_sizes(n: int, percent: int) -> list[int]:
    """The intersections that link a set of n elements to some set of its own or another size."""
    return sorted({needed(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1) if needed(n, m, percent) <= min(n, m)})


def n_subsets(n: int, percent: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, percent))


def boundary(sizes: dict[int, int], heavy_tail: float, list_length: float, percent: int) -> int:
    """The size up to which sets count as small: least cost of subsets made plus list entries read.

    ``sizes`` counts the sets of each size up to SMALL_SET_MAX, ``heavy_tail`` the head elements of larger
    ones, ``list_length`` the mean length of the list a head element is in.
    """
    best, at = math.inf, 0
    for x in range(SMALL_SET_MAX + 1):
        light = sum(k * n_subsets(n, percent) for n, k in sizes.items() if n <= x)
        listed = sum(k * head_size(n, percent) for n, k in sizes.items() if n >= -(-percent * (x + 1) // 100))
        cost = light + (listed + heavy_tail) * (1 + list_length)
        if cost < best:
            best, at = cost, x
    return at


def _subsets(percent: int):
    def enumerate_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, classes, ns = [], [], [], []

            def full() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), pa.array(ns, pa.int64())], names=["key", "size", "class", "n"])

            for c, n, elements in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for size in subset_sizes(n, percent):
                    for chosen in combinations(sorted(elements), size):
                        keys.append(xxhash.xxh3_64_intdigest(np.array(chosen, np.int64).tobytes()) - (1 << 63))
                        sizes.append(size)
                        classes.append(c)
                        ns.append(n)
                if len(keys) > 50_000:
                    yield full()
                    keys, sizes, classes, ns = [], [], [], []
            if keys:
                yield full()

    return enumerate_subsets


def light_links(classes: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links among sets of at most ``limit`` elements: each meets the smallest set that shares one of its subsets.

    Sets with a common subset of c elements link if c reaches what their sizes need, which grows with either
    size; so whatever links within such a group also links to its smallest set, and one star keeps all connected.
    """
    made = classes.where(F.col("n") <= limit).select("class", "n", "head").mapInArrow(_subsets(percent), "key bigint, size int, class bigint, n bigint")
    first = made.groupBy("key", "size").agg(F.min(F.struct("n", "class")).alias("first"), F.count("*").alias("k")).where("k > 1")
    met = made.join(first, ["key", "size"]).where(F.col("class") != F.col("first.class"))
    met = met.where((100 + percent) * F.col("size") >= percent * (F.col("n") + F.col("first.n")))
    return met.select(F.col("class").alias("a"), F.col("first.class").alias("b")).distinct()


def _can_link(percent: int) -> Column:
    """Sizes fit, and the common element stands early enough in both heads to be the first of a large enough intersection."""
    need = F.ceil(percent * (F.col("n") + F.col("n_2")) / F.lit(100 + percent))
    return (F.col("at") <= F.col("n") - need) & (F.col("at_2") <= F.col("n_2") - need)


def list_pairs(listed: DataFrame, percent: int, smallest: int) -> DataFrame:
    """Pairs a < b of classes with a common list, each once; only those with a set of ``smallest`` or more elements."""
    other = listed.select("h", F.col("class").alias("class_2"), F.col("n").alias("n_2"), F.col("at").alias("at_2"))
    fits = (F.col("class") < F.col("class_2")) & (F.greatest("n", "n_2") >= smallest) & _can_link(percent)
    return listed.join(other, "h").where(fits).select(F.col("class").alias("a"), F.col("class_2").alias("b")).distinct()


class MemberFilter:
    """A Bloom filter of 64-bit keys with a fixed number of bits, built in tasks; a miss is certain."""

    def __init__(self, keys: DataFrame, column: str, bits: int = FILTER_BITS, blocks: int = 64):
        self.bits, self.blocks = bits, blocks

        def fill(part: pd.DataFrame) -> pd.DataFrame:
            block = np.zeros(bits // blocks, bool)
            for place in self.places(part["key"].to_numpy(np.int64).view(np.uint64)):
                block[(place % np.uint64(bits // blocks)).astype(np.int64)] = True
            return pd.DataFrame({"block": [int(part["block"].iloc[0])], "bits": [np.packbits(block, bitorder="little").tobytes()]})

        # Bits of the same block from other tasks are joined here; a task sees at most BLOCK_KEYS keys at once.
        parts = keys.select(F.col(column).alias("key"), F.expr(f"CAST(shiftrightunsigned({column}, {64 - int(math.log2(blocks))}) AS int)").alias("block"))
        shards = max(1, parts.count() // (blocks * 100_000))
        parts = parts.withColumn("shard", F.pmod("key", F.lit(shards)))
        made = parts.groupBy("block", "shard").applyInPandas(fill, "block int, bits binary")
        made = made.groupBy("block").applyInPandas(_joined, "block int, bits binary")
        self.data = np.zeros(bits // 8, np.uint8)
        width = bits // blocks // 8
        for row in made.collect():  # bits / 8 bytes
            self.data[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)

    def places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        base = (keys >> np.uint64(64 - int(math.log2(self.blocks)))) * np.uint64(self.bits // self.blocks)
        for probe in range(FILTER_PROBES):
            x = (keys ^ np.uint64(0x9E3779B97F4A7C15 * (probe + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(31)
            yield base + (x % np.uint64(self.bits // self.blocks))

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys):
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _joined(part: pd.DataFrame) -> pd.DataFrame:
    data = np.frombuffer(part["bits"].iloc[0], np.uint8).copy()
    for raw in part["bits"].iloc[1:]:
        data |= np.frombuffer(raw, np.uint8)
    return pd.DataFrame({"block": [int(part["block"].iloc[0])], "bits": [data.tobytes()]})


def _candidate_sets(length: int, asked):
    """Class and whole set of the texts whose class may be asked for."""
    schema = pa.schema([("class", pa.int64()), ("elements", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = [], []
            for raw in raw_texts(batch.column(0)):
                s = shingle_set(raw, length)
                c = class_number(s) if len(s) else 0
                if len(s) and asked.value.maybe(np.array([c], np.int64).view(np.uint64))[0]:
                    names.append(c)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return sets


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures do not prove them too far apart."""

    @F.arrow_udf("boolean")
    def near(a: pa.Array, n: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([may_link(*row, percent) for row in zip(a.to_pylist(), n.to_pylist(), b.to_pylist(), m.to_pylist())], pa.bool_())

    marks = classes.select("class", "n", "sig")
    met = pairs.join(_side(marks, "a"), "a").join(_side(marks, "b"), "b")
    return met.where(near("sig_a", "n_a", "sig_b", "n_b")).select("a", "b")


def _side(table: DataFrame, name: str) -> DataFrame:
    return table.select(*[F.col(c).alias(name if c == "class" else f"{c}_{name}") for c in table.columns])


def whole_sets(asked: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """class, elements of the classes asked for (and of a few others), made again from the texts.

    A Bloom filter of fixed size leaves out the texts of other classes before anything is shuffled.
    """
    wanted = texts.sparkSession.sparkContext.broadcast(MemberFilter(asked, "class"))
    found = texts.select("text").mapInArrow(_candidate_sets(length, wanted), "class bigint, elements binary")
    return staged(found.groupBy("class").agg(F.first("elements").alias("elements")), "sets")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that link, by their whole sets."""

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            out.append(int(found_in(x, y)[0].sum()) >= needed(len(x), len(y), percent))
        return pa.array(out, pa.bool_())

    met = pairs.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
    return met.where(linked("elements_a", "elements_b")).select("a", "b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrix; elements of one set alone are left out."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    number = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    owner, column = owner[keep], number[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        total += part @ part.T
    return total


def _block_links(percent: int):
    def scan(part: pd.DataFrame, leaders: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame(columns=["a", "b"], dtype=np.int64)
        part = part.sort_values("class")
        whole = {c: np.frombuffer(raw, np.uint64) for c, raw in zip(leaders["leader_2"], leaders["elements"])}
        sets = []
        for leader, minus, plus, alone in zip(part["leader"], part["minus"], part["plus"], part["whole"]):
            if alone:
                sets.append(np.frombuffer(plus, np.uint64))
                continue
            base = whole[leader]
            sets.append(np.concatenate([base[~found_in(np.frombuffer(minus, np.uint64), base)[0]], np.frombuffer(plus, np.uint64)]))
        n, cut, names = np.array([len(s) for s in sets]), part["cut"].to_numpy(), part["class"].to_numpy()
        need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
        close = np.triu(overlaps(sets) >= need, 1)
        if cut.min() != cut.max():
            close &= cut[:, None] != cut[None, :]
        root, out = list(range(len(sets))), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        # Links inside what is connected already add nothing.
        for i, j in zip(*np.nonzero(close)):
            x, y = find(int(i)), find(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(names[i]), int(names[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return scan


def _difference():
    """Arrow UDF: what a set lacks of its leader's, and what it has besides; the whole set where that is shorter."""

    @F.arrow_udf("struct<minus:binary,plus:binary,whole:boolean>")
    def difference(own: pa.Array, leader: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(own, leader):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            minus, plus = y[~found_in(x, y)[0]], x[~found_in(y, x)[0]]
            whole = len(minus) + len(plus) >= len(x)
            out.append({"minus": b"" if whole else minus.tobytes(), "plus": (x if whole else plus).tobytes(), "whole": whole})
        return pa.array(out, pa.struct([("minus", pa.binary()), ("plus", pa.binary()), ("whole", pa.bool_())]))

    return difference


def in_blocks(listed: DataFrame) -> DataFrame:
    """Rows of lists (h, class, n) dealt into blocks and repeated for each pair of blocks (lo, hi) of their list that holds them."""
    size = listed.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("elements_in")).where("k > 1")
    cuts = F.greatest(F.ceil(F.col("k") / BLOCK_SETS), F.ceil(F.col("elements_in") / BLOCK_ELEMENTS)).cast("int")
    rows = listed.select("h", "class", "n").join(size, "h").withColumn("cuts", cuts)
    rows = rows.withColumn("cut", F.pmod(F.xxhash64("class"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return rows.select("h", F.least("cut", "other").alias("lo"), F.greatest("cut", "other").alias("hi"), "cut", "class", "n")


def _near_members(percent: int):
    def scan(part: pd.DataFrame) -> pd.DataFrame:
        """The sets with a set near by in the same pair of blocks, by signature, and the smallest class among both."""
        part = part.sort_values("class").reset_index(drop=True)
        n, cut, names = part["n"].to_numpy(), part["cut"].to_numpy(), part["class"].to_numpy()
        marks = [np.frombuffer(raw, np.uint8) for raw in part["sig"]]
        wide, full = np.array([len(m) for m in marks]), np.array([m.max() == 255 for m in marks])
        best = np.full(len(part), -1)
        apart = cut.min() != cut.max()
        for width in np.unique(wide):
            # Sets of sizes that can link have signatures of this width or of twice it, which are folded.
            here = np.flatnonzero((wide == width) | (wide == 2 * width))
            table = np.stack([marks[i].astype(np.int16).reshape(width, -1).sum(axis=1) for i in here]).astype(np.int16)
            for row, i in enumerate(here):
                differ = np.abs(table - table[row]).sum(axis=1, dtype=np.int64)
                both = n[i] + n[here]
                close = (both - 2 * (-(-percent * both // (100 + percent))) >= differ) | full[i] | full[here]
                close &= 100 * np.minimum(n[i], n[here]) >= percent * np.maximum(n[i], n[here])
                close[row] = False
                if apart:
                    close &= cut[here] != cut[i]
                if close.any():
                    first = min(int(i), int(here[np.argmax(close)]))
                    best[i] = first if best[i] < 0 else min(best[i], first)
        keep = best >= 0
        return pd.DataFrame({"h": part["h"][keep], "class": names[keep], "n": n[keep], "leader": names[best[keep]]})

    return scan


def family_links(listed: DataFrame, classes: DataFrame, texts: DataFrame, length: int, percent: int) -> DataFrame:
    """Links among the classes of each long list (h, class, n), enough to connect all that link.

    Long lists come from groups of near copies and from texts of shared passages. A list is dealt into blocks of
    about BLOCK_SETS sets, and each pair of blocks is one task's work, twice: by signatures, which leave the sets
    that have any other near by (few among texts that share a passage only), then by whole sets, as two matrices;
    a task returns a forest, so no row is made for a pair. Sets travel as their difference from a leader, the
    smallest class near by, which is a few elements among near copies; leaders travel whole.
    """
    marked = in_blocks(listed).join(classes.select("class", "sig"), "class")
    near = marked.groupBy("h", "lo", "hi").applyInPandas(_near_members(percent), "h bigint, class bigint, n bigint, leader bigint")
    near = staged(near.groupBy("h", "class", "n").agg(F.min("leader").alias("leader")), "near")
    led = near.groupBy("class").agg(F.min("leader").alias("leader"))
    sets = whole_sets(near.select("class").distinct(), texts, length)
    whole = sets.select(F.col("class").alias("leader"), F.col("elements").alias("elements_leader"))
    coded = led.join(sets, "class").join(whole, "leader")
    coded = staged(coded.select("class", "leader", _difference()("elements", "elements_leader").alias("d")).select("class", "leader", "d.*"), "coded")
    blocks = in_blocks(near)
    members = blocks.join(coded, "class")
    leaders = blocks.join(coded.where("NOT whole").select("class", "leader"), "class").select("h", "lo", "hi", "leader").distinct()
    leaders = leaders.join(whole, "leader").select(F.col("h").alias("h_2"), F.col("lo").alias("lo_2"), F.col("hi").alias("hi_2"), F.col("leader").alias("leader_2"), F.col("elements_leader").alias("elements"))
    met = members.groupBy("h", "lo", "hi").cogroup(leaders.groupBy("h_2", "lo_2", "hi_2"))
    return met.applyInPandas(_block_links(percent), "a bigint, b bigint").distinct()


def frequent(lists: DataFrame) -> tuple[np.ndarray, float, int]:
    """The elements of long lists (h, k) in sorted order, at most HOT_HASHES; the mean list length of an entry with those apart; all entries."""
    # Lengths of lists by powers of two: a few dozen rows.
    spread = lists.groupBy(F.floor(F.log2("k")).cast("int").alias("e")).agg(F.count("*").alias("n"), F.sum("k").alias("entries"))
    spread = {r["e"]: (r["n"], r["entries"]) for r in spread.collect()}
    start = int(math.log2(HOT_LIST))
    while sum(n for e, (n, _) in spread.items() if e >= start) > HOT_HASHES:
        start += 1
    entries = sum(k for _, k in spread.values())
    mean = sum(min(2.0**e, HOT_LIST) * k for e, (_, k) in spread.items()) / max(1, entries)
    if not any(e >= start for e in spread):
        return np.empty(0, np.uint64), mean, entries
    often = lists.where(F.col("k") >= 2**start).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64)
    return np.sort(often), mean, entries


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """key, n_shingles, class, component_id of each document.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``shingle`` words (all
    words where there are fewer). ``component_id`` is the smallest key reachable by links, itself included.

    Equal sets are one class from the start, so exact copies cost one narrow row each. Between classes:

    * Small sets (size up to a boundary chosen by cost from counted sizes and list lengths): subsets of the
      sizes that would link are enumerated, sets meet on a subset, no comparison follows.
    * Large sets: lists of classes by element, one for each element of a head (the first elements in a common
      order that linked sets cannot both have unshared). Elements of many classes (found by an exact count of
      all heads; at most HOT_HASHES are sent to the workers) stand last in that order, so shared passages make
      no long lists. In lists of up to SHORT_LIST all pairs are candidates. In longer ones, which only groups of
      near copies and texts of frequent passages alone still have, sets are cut into blocks of about BLOCK_SETS,
      and pairs of blocks are compared twice (``family_links``): by signatures, which leave out sets that no
      other of the list can link with, and then by the exact sets of the others. Enough links return to connect all that link.

    Elements and classes are 64-bit hashes. Null, empty and wordless texts: n_shingles 0, null class, their own
    key as component (null if that is null). Null keys count as larger than any other. Repeated rows and
    keys: each row gets its line, rows with equal sets are in one component. No rows: no rows. Other columns
    are not read.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sets = staged(rows.select("key", _sets(shingle, percent)("text").alias("s")).select("key", "s.*"), "sets")
    classes = sets.where("n > 0").groupBy("class").agg(F.min("key").alias("low"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("sig").alias("sig"))
    classes = staged(classes, "classes")
    p = F.expr(f"CAST(n - (n * {percent} + 99) div 100 + 1 AS int)")
    heads = classes.select("class", "n", F.slice("head", F.lit(1), p).alias("head"))
    lists = heads.select(F.explode("head").alias("h")).groupBy("h").agg(F.count("*").alias("k"))
    often, list_length, entries = frequent(lists)
    sizes = {r["n"]: r["k"] for r in classes.where(F.col("n") <= SMALL_SET_MAX).groupBy("n").agg(F.count("*").alias("k")).collect()}
    tail = max(0, entries - sum(k * head_size(n, percent) for n, k in sizes.items()))
    limit = boundary(sizes, tail, list_length, percent)
    if len(often):
        hot = context.broadcast(often)
        made = rows.select("text").mapInArrow(_cool_heads(shingle, percent, hot), "class bigint, n bigint, head array<bigint>")
        made = staged(made.groupBy("class").agg(F.first("n").alias("n"), F.first("head").alias("head")), "heads")
        # The other heads stay as they are, where they are.
        heads = heads.where(_is_cool(hot)("head")).unionByName(made)
    listed = heads.where(F.col("n") >= -(-percent * (limit + 1) // 100)).select("class", "n", F.posexplode("head").alias("at", "h"))
    # The list lengths come by a join on the element; single entries, most of all, end here.
    length = listed.groupBy("h").agg(F.count("*").alias("k"), F.min("n").alias("low")).where("k > 1")
    # An element so late in a head that no set of the list is small enough for it ends here too.
    partner = F.greatest(F.col("low"), F.ceil(percent * F.col("n") / F.lit(100)))
    early = F.col("at") <= F.col("n") - F.ceil(percent * (F.col("n") + partner) / F.lit(100 + percent))
    listed = staged(listed.join(length, "h").where(early), "lists")
    pairs = list_pairs(listed.where(F.col("k") <= SHORT_LIST), percent, limit + 1)
    pairs = staged(near_pairs(pairs, classes, percent), "pairs")
    whole = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), rows, shingle)
    links = light_links(classes, limit, percent).unionByName(linked_pairs(pairs, whole, percent))
    links = links.unionByName(family_links(listed.where(F.col("k") > SHORT_LIST), classes, rows, shingle, percent))
    roots = staged(components(links), "roots")
    owned = classes.select("class", "low").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = owned.groupBy("root").agg(F.min("low").alias("component_id"))
    owned = staged(owned.join(lowest, "root").select("class", "component_id"), "owned")
    named = sets.select("key", "n", "class").join(owned, "class", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return named.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "class", component.alias("component_id"))
