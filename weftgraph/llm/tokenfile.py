"""Token-id output: concatenated ids with Elias-Fano document boundaries.

Rows are tokenised on the executors, dealt to ranges of ``doc_id`` and sorted;
the ranges follow a sample of the ids, as in any range exchange, and are as many
as the text's bytes ask for, ``RANGES`` at most.  Rows of one doc_id are ordered
by a hash of their text, and a range may end among them, so that no id, nor
null, fills one task.  Each task cuts its range into shard files of bounded size.  A shard is one
byte string in the layout below, kept as one row of a Parquet table in the
shared folder, so Spark's commit protocol decides which attempt counts when an
executor is lost.  ``start`` of a document is the sum of the ids before it over
all shards; only one total per range reaches the driver.

Reading decodes ``BLOCK`` boundaries at a time, each block found by select; no
64-bit table of a whole shard is made.

Shard layout, little-endian: magic ``EFTK``, version, id width in bytes, then
the number of documents, ids, rows with null doc_id and end id; the Elias-Fano
sequence of document ids (less the smallest); that of the n + 1 boundaries; the ids.

Defined cases: a null text is empty and gives just the end id; null doc_ids
come first; rows that share a doc_id are all kept, in the order of a hash of
their texts; strings of special tokens in a text become those tokens, as the
library has it; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches, only, per_batch, record, scratch, segment_sum, texts, words

#: Every SAMPLE-th set bit has its place kept for select().
SAMPLE = 256
#: Ids in one shard at most, unless one document has more.
SHARD_IDS = 4 << 20
#: The vocabulary's own pre-token pattern, and words of printable Latin-1 characters.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = "^[!-~\u00a1-\u00ac\u00ae-\u00ff]+$"
#: Words that a worker keeps with their ids.
CACHED_WORDS = 600_000
#: Bytes of text in a range, ranges at most, and sampled rows for each range.
RANGE_BYTES, RANGES, SAMPLED = 16 << 20, 20_000, 40
#: Null doc_ids come first, with the least id.
LEAST_ID = -(1 << 63)
#: Boundaries that are decoded at once.
BLOCK = 4096


@dataclass
class EliasFano:
    """A non-decreasing sequence of n values below 2**63 in about 2 + log2(u / n) bits each."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((v[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.uint64)
        start = first * self.low_bits
        some = self.low[start // 8 : (start + count * self.low_bits + 7) // 8]
        bits = np.unpackbits(some, bitorder="little")[start % 8 :][: count * self.low_bits].reshape(count, self.low_bits)
        return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """Value i, read from the sample before it on."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")[at % 8 :]
        while bits.sum() <= left:
            left -= int(bits.sum())
            byte += 1
            at = byte * 8
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        place = at + int(np.flatnonzero(bits)[left])
        return (place - i) << self.low_bits | int(self._low(i, 1)[0])

    def block(self, first: int, count: int) -> np.ndarray:
        """Values first to first + count - 1: select finds where they start, the samples where they end."""
        count = min(count, self.n - first)
        if count <= 0:
            return np.zeros(0, np.uint64)
        begin = (self.select(first) >> self.low_bits) + first  # place of the set bit
        ahead = -(-(first + count) // SAMPLE)
        stop = int(self.samples[ahead]) + 1 if ahead < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : -(-stop // 8)], bitorder="little")
        bits[: begin % 8] = 0
        ones = np.flatnonzero(bits)[:count] + begin // 8 * 8
        return (ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.low_bits) | self._low(first, count)

    def dump(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", data, at)
        at += struct.calcsize("<QBQQQ")
        out = cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c, at + a + b))
        return out, at + a + b + 4 * c


@dataclass
class Shard:
    """The documents of one shard file."""

    nulls: int
    base: int
    doc_ids: EliasFano
    bounds: EliasFano
    ids: np.ndarray

    HEAD = "<4sBBQQQq"

    def dump(self) -> bytes:
        return struct.pack(self.HEAD, b"EFTK", 1, self.ids.dtype.itemsize, self.bounds.n - 1, len(self.ids), self.nulls, self.base) + self.doc_ids.dump() + self.bounds.dump() + self.ids.tobytes()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        magic, version, width, _, n_ids, nulls, base = struct.unpack_from(cls.HEAD, data)
        if magic != b"EFTK" or version != 1:
            raise ValueError("not a token shard")
        view = memoryview(data)
        doc_ids, at = EliasFano.load(view, struct.calcsize(cls.HEAD))
        bounds, at = EliasFano.load(view, at)
        return cls(nulls, base, doc_ids, bounds, np.frombuffer(view, f"<u{width}", n_ids, at))

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, found by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]

    def keys(self, first: int, count: int) -> list[int | None]:
        """The doc_ids of documents first to first + count - 1, fewer at the end."""
        nulls = min(max(self.nulls - first, 0), count)
        return [None] * nulls + [self.base + int(x) for x in self.doc_ids.block(max(first - self.nulls, 0), count - nulls)]

    def blocks(self, size: int = BLOCK) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """(doc_ids, boundaries, one more than the doc_ids) of some documents after another."""
        n = self.bounds.n - 1
        for first in range(0, n, size):
            some = min(size, n - first)
            yield self.keys(first, some), self.bounds.block(first, some + 1).astype(np.int64)


def make_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> Shard:
    known = [x for x in doc_ids if x is not None]
    base = known[0] if known else 0
    return Shard(len(doc_ids) - len(known), base, EliasFano.of(np.array([x - base for x in known], np.uint64)), EliasFano.of(np.concatenate([[0], np.cumsum(lengths)])), ids)


class WordEncoder:
    """Ids of words by the tokenizers library, with the first words seen kept.

    The vocabulary's own pre-tokenizer drops white space and never joins
    characters across it, so a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: In any case of letters, though only the exact string counts: such words aren't lowered before the library sees them.
        self.special = "(?i)" + "|".join(re.escape(t) for t in added) if added else r"\z\A."
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {}

    def _together(self, words: list[str], counts: np.ndarray) -> list[bytes] | None:
        """Encode words as one text and part the ids by the words' numbers of pre-tokens."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, self.dtype)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != counts.sum() or not len(stops) or stops[-1] != len(ids):
            return None
        last = (stops[np.cumsum(counts) - 1] * self.dtype.itemsize).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *last], last, strict=False)]

    def _apart(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def __call__(self, dictionary: list[str]) -> list[bytes]:
        """The ids of each word as bytes, which take far less room than lists."""
        new = [w for w in dictionary if w not in self.kept]
        got: dict[str, bytes] = {}
        column = pa.array(new, pa.string())
        # characters that normalisation leaves one to one, so that pre-tokens can be counted here
        plain = pc.and_(pc.match_substring_regex(column, PLAIN), pc.invert(pc.match_substring_regex(column, self.special)))
        counts = pc.count_substring_regex(column, PRE_TOKEN).to_numpy()
        simple = plain.to_numpy(zero_copy_only=False)
        for index, joined in ((np.flatnonzero(simple), True), (np.flatnonzero(~simple), False)):
            for k in range(0, len(index), 4096):  # an encoding holds far more than its ids
                some = index[k : k + 4096]
                words_ = [new[i] for i in some.tolist()]
                lists = self._together(words_, counts[some]) if joined else None
                got.update(zip(words_, lists or self._apart(words_), strict=True))
        out = [got[w] if w in got else self.kept[w] for w in dictionary]
        if len(self.kept) < CACHED_WORDS:
            self.kept.update(got)
        return out


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_texts(text: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows with their end ids, offsets of the rows)."""
    encoder = _encoder(path)
    codes, offsets, dictionary = words(text)
    if pc.any(pc.match_substring_regex(dictionary, encoder.special), min_count=0).as_py():
        codes, offsets, dictionary = words(text, lower=False)
        dictionary = pc.if_else(pc.match_substring_regex(dictionary, encoder.special), dictionary, pc.ascii_lower(dictionary))
    lists = encoder(dictionary.to_pylist())
    size = np.fromiter(map(len, lists), np.int64, len(lists)) // encoder.dtype.itemsize
    pool = np.frombuffer(b"".join(lists), encoder.dtype)
    first = np.concatenate([[0], np.cumsum(size)])
    per_word = size[codes]
    ends = np.concatenate([[0], np.cumsum(segment_sum(per_word, offsets) + 1)])
    out = np.full(int(ends[-1]), end_id, encoder.dtype)
    to = np.ones(len(out), bool)
    to[ends[1:] - 1] = False
    word_ends = np.cumsum(per_word)
    out[to] = pool[np.repeat(first[codes] - (word_ends - per_word), per_word) + np.arange(int(word_ends[-1]) if len(word_ends) else 0)]
    return out, ends


def _edges(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(doc_ids, hashes, ranges): the last row of each range but the last one, from a sample of (doc_id, hash of the text)."""
    rows, bytes_ = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    ranges = int(max(1, min(RANGES, rows, -(-bytes_ // RANGE_BYTES))))
    key = F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc_id")
    part = docs.select(key, "h").sample(min(1.0, SAMPLED * ranges / rows), 7).toPandas().sort_values(["doc_id", "h"])
    last = part.iloc[[len(part) * k // ranges for k in range(1, ranges)]] if len(part) else part
    last = last.drop_duplicates()
    return last["doc_id"].to_numpy(np.int64), last["h"].to_numpy(np.int64), len(last) + 1


def _range_of(ids: np.ndarray, hashes: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many range ends (doc_id, hash) lie before each row."""
    low, high = (np.searchsorted(edges[0], ids, side=s) for s in ("left", "right"))
    out = low.astype(np.int32)
    at = np.flatnonzero(high > low)  # rows of an id at which ranges end
    for k in np.unique(low[at]).tolist():
        some = at[low[at] == k]
        out[some] += np.searchsorted(edges[1][k : int(high[some[0]])], hashes[some], side="left").astype(np.int32)
    return out


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write shard rows (part, seq, before, n_ids, n_docs, shard) under ``path``."""
    bounded_batches(docs.sparkSession)
    docs = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("h", F.xxhash64("text"))
    *edges, ranges = _edges(docs)

    def tokenise():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, ends = encode_texts(texts(batch, "text"), tokenizer, end_id)
            key = batch.column(0)
            part = _range_of(key.fill_null(LEAST_ID).to_numpy(), batch.column(2).to_numpy(), edges)
            size = ids.dtype.itemsize
            blob = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * size).astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])
            yield record("", part=part, doc_id=key, n=np.diff(ends), ids=blob.cast(pa.binary()), h=batch.column(2))

        return step

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = _encoder(tokenizer).dtype
        state = {"part": -1, "seq": 0, "before": 0}
        keys, lengths, pieces, held = [], [], [], 0

        def flush():
            nonlocal keys, lengths, pieces, held
            ids = np.frombuffer(b"".join(pieces), dtype)
            data = make_shard(keys, np.array(lengths, np.int64), ids).dump()
            out = record("", part=[state["part"]], seq=[state["seq"]], before=[state["before"]], n_ids=[len(ids)], n_docs=[len(keys)], shard=[data])
            state["seq"] += 1
            state["before"] += len(ids)
            keys, lengths, pieces, held = [], [], [], 0
            return out.cast(pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("shard", pa.binary())]))

        for batch in batches:
            for part, key, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if keys and (part != state["part"] or held + n > SHARD_IDS):
                    yield flush()
                if part != state["part"]:
                    state.update(part=part, seq=0, before=0)
                keys.append(key)
                lengths.append(n)
                pieces.append(ids)
                held += n
        if keys:
            yield flush()

    tokens = docs.mapInArrow(per_batch(tokenise), "part int, doc_id long, n long, ids binary, h long")
    ordered = tokens.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "h", "ids").drop("h")
    ordered.mapInArrow(shards, "part int, seq int, before long, n_ids long, n_docs long, shard binary").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shard files."""
    spark = files.sparkSession
    bounded_batches(spark)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toPandas()  # one row a range
    base = dict(zip(totals.part.tolist(), (totals.n.cumsum() - totals.n).astype("int64").tolist(), strict=True))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, before, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard.load(data)
                for keys, bounds in shard.blocks():
                    wide, ends = shard.ids[bounds[0] : bounds[-1]].astype("<u4"), (bounds - bounds[0]).tolist()
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    yield record("", doc_id=pa.array(keys, pa.int64()), start=bounds[:-1] + base[part] + before, n_tokens=np.diff(bounds), ids_crc32=np.array(crc, np.int64))

        return step

    return files.select("part", "before", "shard").mapInArrow(per_batch(make), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write a fresh set of files in the shared folder and read it back."""
    spark = docs.sparkSession
    path = scratch(spark, "token-files") + "/shards"
    write_token_files(docs, tokenizer, end_id, path)
    return read_token_files(spark.read.parquet(path))
