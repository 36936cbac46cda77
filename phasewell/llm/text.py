"""Shared helpers: tables, stable row keys, checkpoints and vectorised word splitting.

The Arrow helpers run inside tasks on one batch of rows at a time. Splitting and dictionary
encoding happen in Arrow's C++ code, so Python touches each *distinct* word of a batch once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once (one longer text is still taken whole). The arrays made
#: from a slice take some twenty times as much, so this bounds a Python worker's memory.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table into the shared folder, compressed, and read it again.

    A lost executor then costs the tasks that it ran, and later readers see one fixed result.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for tables between stages: spark.checkpoint.dir, or the session's own.

    A temporary folder is made only where neither is set and all tasks run in the driver's process
    (master ``local``); elsewhere a machine-local folder would lose what other machines wrote.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
        return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return named


def row_key(*cols: str):
    """64-bit key of a row's listed columns; equal rows share it, nulls are allowed."""
    return F.xxhash64(*[F.col(c) for c in cols])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) == 0:
        return
    part = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def filled(column: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def array_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts of an Arrow UDF's batch in slices, nulls as empty ones."""
    for part in slices(pa.RecordBatch.from_arrays([texts], ["t"]), "t", SLICE_BYTES // 2):
        yield filled(part.column("t"))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text of an array, as ids into a dictionary."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        self._encode(lists)

    def _encode(self, lists: pa.Array) -> None:
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        flat = lists.flatten()
        offsets = offsets - offsets[0]
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if not real.all():
            flat = flat.filter(pa.array(real))
            offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        coded = flat.dictionary_encode()
        #: word ids, text by text
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        #: the words of text i are ids[offsets[i]:offsets[i + 1]]
        self.offsets = offsets
        #: distinct words
        self.words = coded.dictionary

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def lowered(self) -> pa.Array:
        """Distinct words with A-Z in lower case; other letters stay as they are."""
        return pc.ascii_lower(self.words)

    def hashes(self, words: pa.Array | None = None) -> np.ndarray:
        """One 64-bit hash for each word of the texts."""
        words = self.words if words is None else words
        digest = xxhash.xxh64_intdigest
        one = np.fromiter((digest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
        return one[self.ids] if len(one) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer of 64-bit integers (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside each text, and the offsets of each text's windows.

    A text of 1 to k-1 words gives its whole sequence as one window; an empty text gives none.
    """
    counts = np.diff(offsets)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(n)])
    start = np.repeat(offsets[:-1] - out[:-1], n) + np.arange(out[-1])
    acc = np.zeros(out[-1], np.uint64)
    end = np.repeat(offsets[1:], n)
    with np.errstate(over="ignore"):
        for j in range(k):
            at = start + j
            there = at < end
            word = np.where(there, hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else 0, np.uint64(0))
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(j + 1))
    return acc, out


def distinct_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(values, kind="stable")
    # slices hold few texts, so their numbers sort by counting
    order = order[np.argsort(owner[order].astype(np.uint16 if len(offsets) < 65_536 else np.int64), kind="stable")]
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    if len(v):
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    return v, np.concatenate([[0], np.cumsum(np.bincount(o, minlength=len(offsets) - 1))]).astype(np.int64)
