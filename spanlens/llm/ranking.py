"""Ranked lexical search: item terms times document impacts in dense float64 tiles, exact to the last integer."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanlens.llm.common import fresh, raw_texts, staged

BLOCK_TERMS = 500_000
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 512, 1024, 1024
IMPACT_BOUND = 1_000_000  # (10^9 tf) div (1000 tf + 8 m) stays below it, since m is at least 25
EXACT = 1 << 53

# A-Z to lower case, every other ASCII character but 0-9 and a-z to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_FOLD).split() if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Items:
    """One block of items: their ids and, for each, its terms as numbers of the block's vocabulary with repeats."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        counts = [Counter(terms_of(t.encode("utf-8", "replace"))) for t in texts]
        self.vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        self.item = np.fromiter((i for i, c in enumerate(counts) for _ in c), np.int64)
        self.term = np.fromiter((self.vocabulary[t] for c in counts for t in c), np.int64)
        self.repeats = np.fromiter((n for c in counts for n in c.values()), np.int64)


class Tiles:
    """The weighted item terms of a block, cut into vocabulary tiles.

    A tile has at most TILE_TERMS terms, and the sum over its terms of the largest weight that any item gives
    it, times IMPACT_BOUND, stays below ``exact`` (2^53): every partial sum of a row times a column is an
    integer that float64 holds exactly, in whatever order the library adds. A single weight above that limit
    is parted over several tiles. Terms are numbered anew by falling document count, so rare ones share tiles.
    """

    def __init__(self, items: Items, df: np.ndarray, n_docs: int, n_terms: int, exact: int = EXACT):
        self.ids, self.n_docs, self.n_terms = items.ids, n_docs, n_terms
        order = np.lexsort((np.arange(len(df)), -df))
        self.rank = np.empty(len(df), np.int64)
        self.rank[order] = np.arange(len(df))
        weights = np.array([term_weight(n_docs, int(d)) for d in df], np.int64)
        value = items.repeats * weights[items.term] if len(items.term) else np.empty(0, np.int64)
        useful = (value > 0) & (df[items.term] > 0) if len(items.term) else np.empty(0, bool)
        item, term, value = items.item[useful], self.rank[items.term[useful]], value[useful]
        by = np.argsort(term, kind="stable")
        item, term, value = item[by], term[by], value[by]
        limit = max(1, (exact - 1) // IMPACT_BOUND)
        self.tiles = []  # (first term, one past the last, item, term, value)
        while len(term):
            piece = np.minimum(value, limit)
            heads = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
            largest, ends = np.maximum.reduceat(piece, heads), np.append(heads[1:], len(term))
            at = 0
            while at < len(heads):
                total = np.cumsum(largest[at : at + TILE_TERMS])
                stop = at + max(1, int(np.searchsorted(total, limit, "right")))
                a, b = heads[at], ends[stop - 1]
                self.tiles.append((int(term[a]), int(term[b - 1]) + 1, item[a:b], term[a:b], piece[a:b]))
                at = stop
            left = value > limit
            item, term, value = item[left], term[left], (value - piece)[left]

    def impacts(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """Impacts of some documents: document, term (renumbered, ascending) and the integer impact of each pair."""
        m = 100 - 75 + (75 * n * self.n_docs) // self.n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        term = self.rank[term]
        by = np.argsort(term, kind="stable")
        return doc[by], term[by], impact[by].astype(np.float64)

    def scores(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each item tile its first item and the exact scores (items x documents)."""
        doc, term, impact = self.impacts(n, doc, term, tf)
        for first in range(0, len(self.ids), TILE_ITEMS):
            size = min(TILE_ITEMS, len(self.ids) - first)
            total = np.zeros((size, len(n)), np.int64)
            for low, high, item, own, value in self.tiles:
                a, b = np.searchsorted(term, [low, high])
                mine = slice(None) if size == len(self.ids) else (item >= first) & (item < first + size)
                if a == b or not len(item[mine]):
                    continue
                columns, at = np.unique(term[a:b], return_inverse=True)  # the terms that these documents hold
                met = np.searchsorted(columns, own[mine])
                met[met == len(columns)] = 0
                known = columns[met] == own[mine]
                left = np.zeros((size, len(columns)))
                left[item[mine][known] - first, met[known]] = value[mine][known]
                right = np.zeros((len(columns), len(n)))
                right[at, doc[a:b]] = impact[a:b]
                total += (left @ right).astype(np.int64)
            yield first, total


class Best:
    """The k best documents of each item so far; equal scores by ascending key, null keys last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.least = np.ones(n_items, np.int64)  # a score below it can't enter
        self.rows = [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]  # item, score, key, no key

    def add(self, first: int, scores: np.ndarray, keys: np.ndarray, no_key: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[first : first + len(scores), None])
        if not len(item):
            return
        new = [item + first, scores[item, doc], keys[doc], no_key[doc]]
        rows = [np.concatenate(pair) for pair in zip(self.rows, new)]
        by = np.lexsort((rows[2], rows[3], -rows[1], rows[0]))
        rows = [r[by] for r in rows]
        heads = np.concatenate(([True], rows[0][1:] != rows[0][:-1]))
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(heads, np.arange(len(by)), 0))
        self.rows = [r[place < self.k] for r in rows]
        last = place[place < self.k] == self.k - 1
        self.least[self.rows[0][last]] = self.rows[1][last]  # an equal score may still win by its key


def _blocks(items: DataFrame, block_terms: int) -> int:
    """Into how many blocks items are dealt by hash so that none has over two times ``block_terms`` terms, but for one item alone."""
    total, largest = items.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    blocks = max(1, math.ceil(total / block_terms))
    while blocks > 1:
        worst = items.groupBy(F.pmod("hash", F.lit(blocks))).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if worst <= 2 * max(block_terms, largest):
            break
        blocks *= 2
    return blocks


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = 10,
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item, rank, key, score: the ``k`` best documents of each item, score above 0, best first.

    A document's score sums, over the item's terms with repeats, term weight times impact; both are integers,
    and so is every result. Texts are read once a block of items: each becomes its length and the counts of
    the block's terms, written to the shared folder. Document counts of terms come from those rows. Then tiles
    of documents are multiplied with tiles of the block's vocabulary (``Tiles``), and a task keeps only its
    ``k`` best rows of each item, which meet in one ranking by item.

    Items are dealt by hash into blocks of at most about two times ``block_terms`` terms (one longer item is a
    block of its own size), and one block at a time is sent to the workers. More items take more passes.

    ``key`` is a whole number. Equal scores rank by ascending key, null keys last, rows that share a key stay
    apart. Null, empty and wordless texts are no documents and match nothing; such items return no rows. Equal
    (item, text) rows count once; different texts under one item id are ranked apart under that id. Texts of
    any length are counted whole. Empty tables give no rows. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    id_type = items.schema[item].dataType
    id_field, key_ddl = to_arrow_type(id_type), "bigint"
    length = F.arrow_udf(lambda texts: pa.array([len(terms_of(raw)) for raw in raw_texts(texts)], pa.int64()), "bigint").asNondeterministic()
    asked = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text")).distinct()
    asked = staged(asked.select("item", "text", length("text").alias("n"), F.xxhash64("item", "text").alias("hash")), "items").where("n > 0")
    n_blocks = _blocks(asked, block_terms)
    parts = None
    for number in range(n_blocks):
        rows = asked.where(F.pmod("hash", F.lit(n_blocks)) == number).orderBy("hash").select("item", "text").collect()  # one block of bounded size
        block = Items([r["item"] for r in rows], [r["text"] for r in rows])
        part = _search_block(context, docs.select(F.col(f"`{key}`").cast(key_ddl).alias("key"), F.col(f"`{text}`").alias("text")), block, id_type, id_field, k, number)
        parts = part if parts is None else parts.unionByName(part)
    place = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    ranked = parts.withColumn("place", place).where(F.col("place") <= k)
    names = [item]
    for name in ("rank", key, "score"):
        names.append(fresh(ranked.select(*[F.lit(0).alias(n) for n in names]), name))
    return ranked.select(*[F.col(c).alias(n) for c, n in zip(("item", "place", "key", "score"), names)])


def _search_block(context, docs: DataFrame, block: Items, id_type, id_field, k: int, number: int) -> DataFrame:
    sent = context.broadcast(block.vocabulary)
    postings = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = sent.value.get
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                n, terms, counts, offsets = [], [], [], [0]
                for raw in raw_texts(piece.column(1)):
                    words = terms_of(raw)
                    n.append(len(words))
                    known = np.fromiter((t for t in map(find, words) if t is not None), np.int32)
                    own, times = np.unique(known, return_counts=True)
                    terms.append(own)
                    counts.append(times.astype(np.int32))
                    offsets.append(offsets[-1] + len(own))
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(v) if v else np.empty(0, np.int32))) for v in (terms, counts)]
                made = pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), *lists], schema=postings)
                yield made.filter(pa.array([x > 0 for x in n]))

    found = staged(docs.mapInArrow(count, "key bigint, n bigint, terms array<int>, counts array<int>"), "postings")
    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(block.vocabulary), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # no more rows than the block has terms
        df[r["t"]] = r["count"]
    tiles = context.broadcast(Tiles(block, df, n_docs, n_terms))
    ids = pa.array(block.ids, id_field)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Best(len(tiles.value.ids), k)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCS):
                piece = batch.slice(start, TILE_DOCS)
                key, n, terms, counts = piece.columns
                sizes = terms.value_lengths().to_numpy()
                arrays = [c.flatten().to_numpy().astype(np.int64) for c in (terms, counts)]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                no_key = key.is_null().to_numpy(zero_copy_only=False)
                for first, scores in tiles.value.scores(n.to_numpy(), doc, *arrays):
                    kept.add(first, scores, key.fill_null(0).to_numpy(), no_key)
        row, score, key, no_key = kept.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int32()), ids.take(pa.array(row)), pa.array(key, mask=no_key), pa.array(score)], names=["row", "item", "key", "score"]
        )

    out = found.mapInArrow(best, f"row int, item {id_type.simpleString()}, key bigint, score bigint")
    return out.withColumn("block", F.lit(number))
