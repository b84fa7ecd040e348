"""Repeated passages of three lines: windows of consecutive lines are hashed, and later occurrences are cut out of the texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlens.llm.common import WORD_RE, fresh, row_key

WINDOW = 3


def line_windows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, id, place, digest of each run of ``window`` lines with words; ``place`` counts such lines from 0."""
    lines = f"filter(split(text, '\\n', -1), l -> l RLIKE r'{WORD_RE}')"
    items = ", ".join(f"get(lines, i + {k})" for k in range(window))
    held = rows.withColumn("lines", F.expr(lines)).where(F.size("lines") >= window)
    runs = F.expr(f"transform(sequence(0, size(lines) - {window}), i -> unhex(md5(concat_ws('\\n', {items}))))")
    return held.select("key", "id", F.posexplode(runs).alias("place", "digest"))


def _cut(window: int):
    result = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64())])

    @F.arrow_udf("struct<text:string,n_lines:bigint,n_removed:bigint>")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for value, starts in zip(texts, places):
            text = value.as_py()
            lines = (text or "").split("\n")
            covered = {p + k for p in (starts.as_py() or ()) for k in range(window)}
            kept, number, removed = [], 0, 0
            for line in lines:
                if line.strip(" \t\n\x0b\x0c\r"):
                    if number in covered:
                        removed += 1
                    else:
                        kept.append(line)
                    number += 1
                else:
                    kept.append(line)
            # Only gaps are left: nothing of the text is.
            kept_text = text if not removed else "" if removed == number else "\n".join(kept)
            out.append({"text": kept_text, "n_lines": number, "n_removed": removed})
        return pa.array(out, result)

    # Else a filter on the result would run it once more.
    return cut.asNondeterministic()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with a struct column ``deduped``: text without later repeats, n_lines, n_removed.

    Lines are parted by ``\\n``; only lines with a word count. Every run of ``window`` such lines is hashed (128
    bits). Of equal runs the first stays, by key (null last), then by a digest of key and text, then by place,
    within texts as well as between them; the lines that any later run covers go. Lines without words stay, unless
    nothing else is left: then the text is empty. Texts of fewer than ``window`` lines are left alone.

    The first place of each run is a partial aggregate; runs found once end there, so a line that a third of
    all texts share leaves each task once. Later places return by a join on the digest, which is split if
    skewed, and meet per text as a set of numbers.

    Null text: stays null, no lines. Empty text: stays, no lines. The same row repeated counts as one text, all
    its copies get the same answer (overlapping repeats count too: four equal lines become one, three stay); rows with one key and other texts are texts of their own. A column called
    ``deduped`` stays; the new one is then ``deduped_1``.
    """
    own = docs.withColumn(fresh(docs, "__row"), row_key(key, text))
    mark = own.columns[-1]
    rows = own.select(F.col(f"`{mark}`").alias("key"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    runs = line_windows(rows, window)
    spot = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "place")
    first = runs.groupBy("digest").agg(F.min(spot).alias("first"), F.count("*").alias("k")).where("k > 1")
    later = runs.join(first, "digest").where((F.col("key") != F.col("first.key")) | (F.col("place") != F.col("first.place")))
    covered = fresh(own, "__places")
    places = later.groupBy("key").agg(F.collect_set("place").alias(covered)).withColumnRenamed("key", mark)
    joined = own.join(places, mark, "left")
    result = _cut(window)(F.col(f"`{text}`"), F.col(covered))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], result.alias(fresh(docs, "deduped")))
