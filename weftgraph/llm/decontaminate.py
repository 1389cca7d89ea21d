"""Benchmark decontamination: SimHash windows, a multi-index, exact verification.

Texts and benchmark items are sequences of word shingles (lower case, outer
punctuation cut).  A shingle weighs the less the more items hold it.  For each
item length, windows of that many shingles slide over a text, by one shingle at
a time.  A window's 64-bit SimHash is looked up in the items' fingerprints: four
blocks of 16 bits, of which at least one lies within RADIUS // 4 bits if the
whole lies within RADIUS, so the index holds every block value that near, and
finds every fingerprint within RADIUS.  Shingles count in it by the square root
of their weights, so that its angle is of the weights themselves.  As any radius
loses some, a window is also a candidate for each item with which it shares
enough weight, by the items' shingle lists.  Candidates are verified by the exact
weighted Jaccard similarity of the shingle multisets; at least ``least`` counts.

Windows that can't be similar are left out beforehand without loss: a window of
which the shingles that any item holds make up less than ``least`` of its
weight has a smaller similarity with every item.

Items reach the executors as one index of bounded size; more items are taken in
several passes, with the weights that all items together give.

Defined cases: null and empty texts match nothing, nor do null items; texts or
items of fewer words than a shingle count as one shingle; a text shorter than
an item is one window; repeated rows are reported each, and repeated items
under each id; rows with null doc_id are reported with it; empty tables give no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches, map_rows, mix, only, per_batch, record, shingle_hashes, texts, word_hashes, words

LEAST, WIDTH, RADIUS = 0.75, 5, 19
#: Items in one index; the table of near block values grows with it.
ITEMS = 2000


@cache
def _near(bits: int) -> np.ndarray:
    """All 16-bit values with at most so many bits set."""
    return np.array([sum(1 << b for b in some) for n in range(bits + 1) for some in combinations(range(16), n)], np.uint16)


def item_shingles(text: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets, dictionary = words(text, lower=False)
    bare = pc.replace_substring_regex(pc.utf8_lower(dictionary), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return shingle_hashes(word_hashes(bare)[codes], offsets, width)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    bits = np.unpackbits(mix(shingles).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def fold_bits(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a sorted array, and where each one's run starts and ends."""
    values, first = np.unique(a, return_index=True)
    return values, first, np.append(first, len(a))[1:]


@dataclass
class ItemIndex:
    """Items' shingles with weights, their fingerprints, and per block the items near each value."""

    item_ids: list
    sets: list[dict[int, int]]
    sizes: np.ndarray
    known: np.ndarray
    weights: np.ndarray
    prints: np.ndarray
    near: list[tuple[np.ndarray, np.ndarray]]
    radius: int = RADIUS
    mass: np.ndarray | None = None
    #: Per known shingle, where its items start, and the items.
    lists: tuple[np.ndarray, np.ndarray] | None = None
    #: Which known shingles these items hold, if others are known too.
    own: np.ndarray | None = None

    @classmethod
    def build(cls, item_ids: list, texts_: list[str], width: int = WIDTH, radius: int = RADIUS, shared: tuple[np.ndarray, np.ndarray] | None = None) -> ItemIndex:
        """``shared``: the shingles that several of all items hold, ascending, and how many hold each; without it, these items are all."""
        flat, ends = item_shingles(pa.array(texts_, pa.large_string()), width)
        rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        full = [k for k, r in enumerate(rows) if len(r)]
        rows, item_ids = [rows[k] for k in full], [item_ids[k] for k in full]
        held = np.concatenate([np.unique(r) for r in rows]) if rows else np.zeros(0, np.uint64)
        # items may repeat: what counts is how many different items hold a shingle
        distinct = {tuple(r.tolist()): np.unique(r) for r in rows}
        known, often = np.unique(np.concatenate(list(distinct.values())) if rows else held, return_counts=True)
        own = None
        if shared:
            held = known
            known = np.union1d(held, shared[0])
            often = np.ones(len(known), np.int64)
            often[np.searchsorted(known, shared[0])] = shared[1]
            own = np.isin(known, held)
        out = cls(item_ids, [], np.array([len(r) for r in rows], np.int64), known, 1 / often, np.zeros(0, np.uint64), [], radius)
        out.own = own
        out.sets = [dict(zip(*(x.tolist() for x in np.unique(r, return_counts=True)), strict=True)) for r in rows]
        out.mass = np.array([out.weigh(r)[0].sum() for r in rows], float)
        where = np.concatenate([np.searchsorted(out.known, np.unique(r)) for r in rows]) if rows else np.zeros(0, np.int64)
        holder = np.repeat(np.arange(len(rows)), [len(x) for x in out.sets])
        order = np.argsort(where, kind="stable")
        out.lists = np.searchsorted(where[order], np.arange(len(out.known) + 1)), holder[order]
        out.prints = np.array([fold_bits((signs(r) * np.sqrt(out.weigh(r)[0])[:, None]).sum(0)[None])[0] for r in rows], np.uint64)
        for block in range(4):
            value = (out.prints >> np.uint64(16 * block)).astype(np.uint16)
            values = (value[:, None] ^ _near(radius // 4)[None, :]).ravel()
            items = np.repeat(np.arange(len(rows)), len(_near(radius // 4)))
            order = np.argsort(values, kind="stable")
            out.near.append((np.searchsorted(values[order], np.arange(65537)), items[order].astype(np.int32)))
        return out

    def weigh(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each shingle (1 for one that no item holds), and whether an item of this index holds it."""
        if not len(self.known):
            return np.ones(len(shingles)), np.zeros(len(shingles), bool)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        hit = self.known[at] == shingles
        return np.where(hit, self.weights[at], 1.0), hit if self.own is None else hit & self.own[at]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of all fingerprints within the radius."""
        found = []
        for block, (first, items) in enumerate(self.near):
            value = (prints >> np.uint64(16 * block)).astype(np.int64) & 0xFFFF
            n = first[value + 1] - first[value]
            window = np.repeat(np.arange(len(prints)), n)
            stop = np.cumsum(n)
            item = items[np.repeat(first[value] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.append(window[close] * len(self.prints) + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(len(self.prints), 1), pairs % max(len(self.prints), 1)

    def sharing(self, shingles: np.ndarray, weight: np.ndarray, hit: np.ndarray, start: np.ndarray, size: int, mass: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs whose shared weight allows a similarity of ``least``."""
        at = np.flatnonzero(hit)
        first, items = self.lists
        known = np.searchsorted(self.known, shingles[at])
        n = first[known + 1] - first[known]
        stop = np.cumsum(n)
        item = items[np.repeat(first[known] - (stop - n), n) + np.arange(int(stop[-1]))]
        place = np.repeat(at, n)
        right = (self.sizes[item] == size) | ((size == len(shingles)) & (self.sizes[item] > size))
        right &= (np.bincount(item, weight[place], len(self.sizes)) >= least * self.mass - 1e-9)[item]
        order = np.argsort(item[right], kind="stable")
        item, place = item[right][order], place[right][order]
        windows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, a, b in zip(*(x.tolist() for x in _runs(item)), strict=True):
            run = np.concatenate([[0], np.cumsum(weight[place[a:b]])])
            shared = run[np.searchsorted(place[a:b], start + size)] - run[np.searchsorted(place[a:b], start)]
            enough = np.flatnonzero(shared >= least * np.maximum(mass, self.mass[k]) - 1e-9)
            windows.append(enough)
            found.append(np.full(len(enough), k))
        return np.concatenate(windows), np.concatenate(found)

    def similarity(self, window: np.ndarray, weight: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of two shingle multisets."""
        own = self.sets[item]
        values, first, count = np.unique(window, return_index=True, return_counts=True)
        both = total = 0.0
        left = dict(own)
        for s, k, n in zip(values.tolist(), first.tolist(), count.tolist(), strict=True):
            m = left.pop(s, 0)
            both += weight[k] * min(n, m)
            total += weight[k] * max(n, m)
        rest = np.array(list(left), np.uint64)
        total += float((self.weigh(rest)[0] * np.array(list(left.values()), float)).sum()) if len(rest) else 0.0
        return both / total if total else 0.0

    def matches(self, shingles: np.ndarray, least: float = LEAST) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first shingle, shingles) of the best window of its length for each item that the text holds."""
        weight, hit = self.weigh(shingles)
        if not hit.any():
            return []
        total = np.concatenate([[0], np.cumsum(weight)])
        held = np.concatenate([[0], np.cumsum(weight * hit)])
        turns = None
        best: dict[int, tuple[float, int, int]] = {}
        for size in np.unique(np.minimum(self.sizes, len(shingles))).tolist():
            start = np.arange(len(shingles) - size + 1)
            start = start[(held[start + size] - held[start]) >= least * (total[start + size] - total[start]) - 1e-9]
            if not len(start):
                continue
            if turns is None:
                turns = self._turns(shingles, weight, hit)
            a, b = turns[0][start], turns[0][start + size]
            prints = fold_bits(turns[1][b] - turns[1][a])
            window, item = self.candidates(prints)
            # a window stands for the items of its own length, or, if it is the whole text, for longer ones
            own = (self.sizes[item] == size) | ((size == len(shingles)) & (self.sizes[item] > size))
            mass, shared = total[start + size] - total[start], held[start + size] - held[start]
            more = self.sharing(shingles, weight, hit, start, size, mass, least)
            pairs = np.unique(np.concatenate([window[own] * len(self.sizes) + item[own], more[0] * len(self.sizes) + more[1]]))
            window, item = pairs // len(self.sizes), pairs % len(self.sizes)
            bound = np.minimum(shared[window], self.mass[item]) / np.maximum(mass[window], self.mass[item])
            for k in np.lexsort((window, -bound)).tolist():
                s, item_ = int(start[window[k]]), int(item[k])
                if bound[k] < max(least, best[item_][0] if item_ in best else 0) - 1e-9:
                    continue
                if item_ in best and best[item_][0] >= bound[k] - 1e-12 and (best[item_][1], best[item_][2]) <= (s, size):
                    continue  # it can't be better, nor as good and earlier
                value = self.similarity(shingles[s : s + size], weight[s : s + size], item_)
                if value >= least - 1e-9 and (item_ not in best or (-value, s, size) < (-best[item_][0], *best[item_][1:])):
                    best[item_] = (value, s, size)
        return [(item, *found) for item, found in sorted(best.items())]

    def _turns(self, shingles: np.ndarray, weight: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of weighted signs, kept only around the shingles that items hold."""
        reach = int(self.sizes.max()) + 1
        near = np.zeros(len(shingles) + 1, np.int64)
        at = np.flatnonzero(hit)
        np.add.at(near, np.maximum(at - reach, 0), 1)
        np.add.at(near, np.minimum(at + reach, len(shingles)), -1)
        use = np.cumsum(near)[:-1] > 0
        place = np.concatenate([[0], np.cumsum(use)])
        sums = np.zeros((int(use.sum()) + 1, 64), np.float32)
        np.cumsum(signs(shingles[use]) * np.sqrt(weight[use])[:, None], axis=0, out=sums[1:])
        return place, sums


def _shared_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several different items hold, ascending, and how many hold each."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, ends = item_shingles(texts(batch, "text"))
            rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            held = [np.unique(r) for r in rows]
            item = np.repeat(np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows], np.uint64), [len(h) for h in held])
            return record("", shingle=np.concatenate([*held, flat[:0]]).view(np.int64), item=item.view(np.int64))

        return step

    found = items.select("text").mapInArrow(per_batch(make), "shingle long, item long").distinct()
    got = found.groupBy("shingle").count().filter("count > 1").toArrow()
    shingles, often = got["shingle"].to_numpy().view(np.uint64), got["count"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], often[order]


def _indexes(items: DataFrame, item_id: str, text: str):
    """One index after another over ``ITEMS`` items each."""
    items = only(items, item_id=item_id, text=text).filter(F.col("text").isNotNull())
    count = items.count()
    slices = max(1, -(-count // ITEMS))
    shared = _shared_shingles(items) if slices > 1 else None
    for k in range(slices):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        yield ItemIndex.build([r.item_id for r in some], [r.text for r in some], shared=shared)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, similarity, first_shingle, n_shingles): the best window for each item that a text holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    out = None
    for index in _indexes(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                index = shared.value
                found = [(key, m) for key, m in _found(index, batch, batch.column(0).to_pylist(), least)]
                return record("", doc_id=pa.array([k for k, _ in found], pa.int64()), item_id=pa.array([index.item_ids[m[0]] for _, m in found], pa.int64()), similarity=pa.array([m[1] for _, m in found], pa.float64()), first_shingle=pa.array([m[2] for _, m in found], pa.int64()), n_shingles=pa.array([m[3] for _, m in found], pa.int64()))

            return step

        part = docs.mapInArrow(per_batch(make), "doc_id long, item_id long, similarity double, first_shingle long, n_shingles long")
        out = part if out is None else out.union(part)
    return out


def _found(index: ItemIndex, batch: pa.RecordBatch, keys: list, least: float):
    """(key, match) of all rows; rows without any item's shingle are passed over at once."""
    flat, ends = item_shingles(texts(batch, "text"))
    _, hit = index.weigh(flat)
    some = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit)])[ends]) > 0)
    for k in some.tolist():
        for m in index.matches(flat[ends[k] : ends[k + 1]], least):
            yield keys[k], m


def drop_leaks(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for index in _indexes(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(index)

        def make(shared=shared):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                bad = {k for k, _ in _found(shared.value, batch, list(range(batch.num_rows)), least)}
                return batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_()))

            return step

        docs = map_rows(docs, make, docs.schema)
    return docs
