"""Arrow and numpy helpers shared by the operators: words, hashes, segments.

Everything here works on one Arrow batch and keeps whole texts.  A word is a
maximal run of characters other than the six ASCII white-space characters.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.shipping import ship

#: Rows and bytes of one Arrow batch at most, the same for all operators: results are lazy and the setting is the session's.
BATCH_ROWS, BATCH_BYTES = 20_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, by rows and by bytes; sends it this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(True))


def texts(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The text column with null as the empty string, in 64-bit offsets."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, dictionary): words of row i are dictionary[codes[offsets[i]:offsets[i+1]]]."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    ends = split.offsets.to_numpy()
    flat = split.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    ends = (ends - ends[0]).astype(np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(keep, min_count=0).as_py():
        mask = keep.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(mask)])[ends]
        flat = flat.filter(keep)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), ends, coded.dictionary


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each entry."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(dictionary))


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each flat position the row that it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values; an empty row has 0.  Each row's sum depends on that row alone."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word shingles in order, with offsets.

    A row of fewer than ``width`` words has its whole sequence as one shingle;
    a row without words has none.
    """
    n = np.diff(offsets)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(offsets[:-1] - ends[:-1], count) + np.arange(ends[-1])
    out = np.repeat(mix(np.minimum(n, width).astype(np.uint64)), count)
    last = np.repeat(offsets[1:], count)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(width):
            step = mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[start + k] + np.uint64(k + 1))
            out = np.where(start + k < last, step, out)
    return out, ends


def shingles_of(text: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of whole texts, repeated ones included."""
    codes, offsets, dictionary = words(text)
    return shingle_hashes(word_hashes(dictionary)[codes], offsets, width)


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None]]) -> Callable:
    """A mapInArrow function; ``make`` runs once a task, its result once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            out = step(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out
        give_back()

    return run


def map_rows(df: DataFrame, make: Callable[[], Callable], schema) -> DataFrame:
    """mapInArrow over all columns of ``df``, which may have any names, such as ones with dots."""
    names = df.columns

    def named():
        step = make()
        return lambda batch: step(batch.rename_columns(names))

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(per_batch(named), schema)


def give_back() -> None:
    """Return freed memory to the system: workers serve one task after another."""
    pa.default_memory_pool().release_unused()
    try:
        _libc().malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@cache
def _libc():
    import ctypes

    return ctypes.CDLL("libc.so.6")


def record(schema: str | pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch from arrays, numpy arrays or lists, in keyword order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def only(df: DataFrame, **names: str) -> DataFrame:
    """Just the named columns under the operator's own names, so that other columns can't clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in names.items()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; sets one of its own only in a local session without one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = _local_checkpoints()
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, which goes when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


@cache
def _local_checkpoints() -> str:
    import tempfile

    return tempfile.mkdtemp(prefix="checkpoints-")
