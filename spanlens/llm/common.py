"""Helpers shared by the operators: shared tables, free column names, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_RE = r"[^\x20\x09-\x0D]+"
GAP_RE = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on one machine only, a temporary one where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="spanlens-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: later steps and lost executors re-read files, nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``, … that no column of ``df`` has (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    number, out = 0, name
    while out.lower() in taken:
        number += 1
        out = f"{name}_{number}"
    return out


def row_key(*columns: str) -> Column:
    """A 128-bit digest of columns of any type, nulls told apart from empty values."""
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x1f", *parts)))


def raw_texts(column: pa.Array, step: int = 500) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, without decoding; ``step`` texts are copied at once."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for start in range(0, len(column), step):
        yield from column.slice(start, step).cast(kind).to_pylist()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def space_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: exactly ``[^\\x20\\x09-\\x0D]+``."""
    return text.lower().split() if text else []


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` consecutive word hashes; order matters."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(length):
        out ^= words[i : i + n]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(32)
    return out


def found_in(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``values`` occur in ``sorted_values`` and where the first one stands."""
    if not len(sorted_values):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values, at
