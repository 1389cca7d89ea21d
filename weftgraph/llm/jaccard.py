"""Exact n-gram Jaccard join in the metric space d = 1 - Jaccard.

1.  Singletons as first pivots.  The distance of a set x to {s} is 1 - 1/|x| if
    s is in x and 1 otherwise, so the cell of {s} is all sets with s.  Shingles
    have a common order: those in many documents last (counted over all
    documents), the others by hash.  If d(x, y) <= t, x and y share one of the
    first |x| - ceil((1 - t)|x|) + 1 shingles of each, so a set is replicated
    to just those cells, and a pair has to meet in so many of them that enough
    common shingles are left (see _regions).
2.  Documents as pivots.  Pairs that are left form regions around their least
    neighbour.  A region chooses pivots, gives each set to the Voronoi cell of
    its nearest pivot, and replicates it to cell j if d_j - d_i <= 2t; cells
    join recursively.  Sets within t of one pivot are one component and need
    no test among themselves; |d(x,p) - d(y,p)| > t rules a pair out.
3.  A region too large for a task is joined by rounds over Spark: all members
    meet a few pivots, members within t of pivots that are one component are
    settled, and new pivots come from the rest; the rest then meets all members
    in blocks, with the triangle bound.

Pivots over the whole corpus wouldn't part it: nearly all pairs of documents
are at distance 1 from each other and from any document pivot, so every window
would hold everything; hence step 1.

Links are only gathered as far as components need them.  Exact copies have one
digest and are joined by it.

Defined cases: null and empty texts have the empty set and link with nothing;
rows with null doc_id take no part and have a null component; rows that share a
doc_id are one document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches, give_back, only, per_batch, record, row_of, shared_dir, shingles_of, texts
from .components import components

#: Numerator and denominator of the least similarity.
NUM, DEN = 75, 100
#: Shingles in so many documents come last in the common order; so many of them at most are broadcast.
COMMON, COMMON_MOST = 64, 1 << 18
#: Cells of up to so many sets are thinned pair by pair; regions beyond so many members are joined over Spark.
PAIRWISE, REGION = 64, 3000
#: Rows of ids that are broadcast at most; beyond that the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: A key with more rows than this, or than this part of all rows, is hot; so hot keys are at most HOT_KEYS or rows / HOT_ROWS, and can be broadcast.
HOT_ROWS, HOT_KEYS = 32, 50_000
#: Large regions that are joined in one pass, about.
LARGE_REGIONS = 500
#: Shingle places that one task of the singleton cells gets.
CELL_ROWS = 500_000


def _need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of a set of size n with any linked set."""
    return -(-num * n // den)


def linked(common, a, b, num: int = NUM, den: int = DEN):
    return den * common >= num * (a + b - common)


def _sets(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row, with offsets."""
    flat, ends = shingles_of(text, width)
    row = row_of(ends)
    order = np.lexsort((flat, row))
    flat, row = flat[order], row[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
    flat, row = flat[new], row[new]
    return flat, np.searchsorted(row, np.arange(len(ends)))


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(c.tobytes() for c in columns), 1)


def _unpack(blob: bytes, rows: int, *types: str) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(blob), 0, []
    for t in types:
        out.append(np.frombuffer(data, t, rows, at))
        at += out[-1].nbytes
    return out


def common_shingles(docs: DataFrame, width: int, parts: int) -> np.ndarray:
    """Prefixes of 40 bits of the shingles that many documents hold, commonest last.

    Counts cover all documents.  The list is what gets broadcast; its threshold
    doubles until it is short enough.
    """

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            flat, _ = _sets(texts(batch, "text"), width)
            key, n = np.unique(flat >> np.uint64(24), return_counts=True)
            cuts = np.searchsorted(key, (np.arange(parts + 1) * ((1 << 40) / parts)).astype(np.uint64))
            cuts[-1] = len(key)
            for p in range(parts):
                a, b = cuts[p], cuts[p + 1]
                if b > a:
                    gap = np.diff(key[a:b], prepend=key[a]).astype("<u4" if b - a > 1 and int(np.diff(key[a:b]).max()) < 1 << 32 else "<u8")
                    planes = np.ascontiguousarray(gap.view(np.uint8).reshape(-1, gap.itemsize).T)
                    blob = _pack(planes, np.minimum(n[a:b], 65535).astype("<u2"))
                    yield record("", part=pa.array([p], pa.int32()), rows=pa.array([b - a], pa.int64()), first=pa.array([int(key[a])], pa.int64()), size=pa.array([gap.itemsize], pa.int32()), blob=[blob])

        return step

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold():
            nonlocal keys, counts, held
            k = np.concatenate([keys, *(h[0] for h in held)])
            c = np.concatenate([counts, *(h[1] for h in held)])
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
            keys, counts, held = k[first], np.add.reduceat(c, first) if len(k) else c, []

        for batch in batches:
            for rows, first, size, blob in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                data = zstandard.decompress(blob)
                planes = np.frombuffer(data, np.uint8, rows * size).reshape(size, rows).T
                gap = np.ascontiguousarray(planes).view(f"<u{size}").ravel().astype(np.uint64)
                held.append((np.cumsum(gap).astype(np.uint64) + np.uint64(first), np.frombuffer(data, "<u2", rows, rows * size).astype(np.int64)))
                if sum(len(h[0]) for h in held) > 2_000_000:
                    fold()
        fold()
        top = counts >= COMMON
        yield record("", key=keys[top].astype(np.int64), n=counts[top])
        give_back()

    counted = docs.mapInArrow(per_batch(make), "part int, rows long, first long, size int, blob binary").repartitionById(parts, F.col("part")).mapInArrow(count, "key long, n long").checkpoint()
    least = COMMON
    while counted.filter(F.col("n") >= least).count() > COMMON_MOST:
        least *= 2
    rows = counted.filter(F.col("n") >= least).toArrow().sort_by([("n", "ascending"), ("key", "ascending")])
    return rows["key"].to_numpy().astype(np.uint64)


def _cells(batch: pa.RecordBatch, common, width: int, parts: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Replicate each set to the cells of its first shingles; also one row of (doc_id, size, digest) a document."""
    order, place = common
    flat, ends = _sets(texts(batch, "text"), width)
    n = np.diff(ends)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    view = memoryview(flat.astype("<u8").tobytes())
    digest = [xxhash.xxh3_128_digest(view[8 * a : 8 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    lead = np.frombuffer(b"".join(digest), ">u8").reshape(-1, 2)[:, 0] if digest else np.zeros(0, np.uint64)
    yield record("", part=pa.array(np.abs(ids.astype(np.int64)) % parts, pa.int32()), doc_id=pa.array(ids, pa.int64()), n=pa.array(n, pa.int64()), digest=pa.array(digest, pa.binary()), rows=pa.nulls(len(n), pa.int64()), blob=pa.nulls(len(n), pa.binary()))
    # copies within a batch need one set only
    least = np.lexsort((ids, lead))
    chosen = np.zeros(len(n), bool)
    if len(n):
        chosen[least[np.concatenate([[True], lead[least][1:] != lead[least][:-1]])]] = True
    keep = chosen & (n > 0)
    row = row_of(ends)
    held = keep[row]
    flat, row = flat[held], row[held]
    rank = np.zeros(len(flat), np.int64)
    if len(order):
        at = np.minimum(np.searchsorted(order, flat >> np.uint64(24)), len(order) - 1)
        rank = np.where(order[at] == flat >> np.uint64(24), place[at] + 1, 0)
    by = np.lexsort((flat, rank, row))
    flat, row = flat[by], row[by]
    begin = np.searchsorted(row, np.arange(len(n) + 1))
    pos = np.arange(len(flat)) - begin[row]
    first = pos < (n - _need(n, num, den) + 1)[row]
    token, row, pos = flat[first] >> np.uint64(24), row[first], pos[first]
    part = (token * np.uint64(parts) >> np.uint64(40)).astype(np.int64)
    by = np.lexsort((row, part))
    token, row, pos, part = token[by], row[by], pos[by], part[by]
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        if b > a:
            r = row[a:b]
            low = (token[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4")
            high = (token[a:b] >> np.uint64(32)).astype("u1")
            blob = _pack(ids[r].astype("<i8"), n[r].astype("<u4"), lead[r].astype("<u8"), pos[a:b].astype("<u4"), high, low)
            yield record("", part=pa.array([p], pa.int32()), doc_id=pa.nulls(1, pa.int64()), n=pa.nulls(1, pa.int64()), digest=pa.nulls(1, pa.binary()), rows=pa.array([b - a], pa.int64()), blob=pa.array([blob], pa.binary()))


def _meetings(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """What is left of the cells of one part; document rows pass through."""
    got = []
    for batch in batches:
        is_doc = batch.column(4).is_null()
        docs = batch.filter(is_doc)
        if docs.num_rows:
            yield _met("d", u=docs.column(1), n=docs.column(2), digest=docs.column(3))
        rest = batch.filter(pa.compute.invert(is_doc))
        for rows, blob in zip(rest.column(4).to_pylist(), rest.column(5).to_pylist(), strict=True):
            d, n, digest, pos, high, low = _unpack(blob, rows, "<i8", "<u4", "<u8", "<u4", "u1", "<u4")
            got.append((high.astype(np.uint64) << np.uint64(32) | low, d, n.astype(np.int64), digest, pos.astype(np.int64)))
    if not got:
        return
    token, doc, n, digest, pos = (np.concatenate(c) for c in zip(*got, strict=True))
    order = np.lexsort((doc, digest, token))
    token, doc, n, digest, pos = token[order], doc[order], n[order], digest[order], pos[order]
    # one of each set of equal sets; its digest joins the others
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])
    token, doc, n, pos = token[new], doc[new], n[new], pos[new]
    _, group, size = np.unique(token, return_inverse=True, return_counts=True)
    keep = size[group] > 1
    doc, n, pos, group = doc[keep], n[keep], pos[keep], group[keep]
    size = size[group]
    # large cells become regions; in small ones pairs of fitting sizes count the cells that they share
    large = size > PAIRWISE
    rows = np.flatnonzero(large)
    rows = rows[np.lexsort((doc[rows], group[rows]))]
    first = np.concatenate([[True], group[rows][1:] != group[rows][:-1]]) if len(rows) else np.zeros(0, bool)
    center = doc[rows][np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))] if len(rows) else doc[:0]
    members = np.unique(np.stack([center, doc[rows]], 1), axis=0)
    yield _met("m", u=members[:, 0], v=members[:, 1])
    g, n = group[~large], n[~large]
    ids, local = np.unique(doc[~large], return_inverse=True)
    sizes = np.zeros(len(ids), np.int64)
    sizes[local] = n
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[np.ndarray] = []

    def fold():
        nonlocal keys, counts, held
        k = np.concatenate([keys, *held])
        c = np.concatenate([counts, np.ones(len(k) - len(keys), np.int64)])
        keys, where = np.unique(k, return_inverse=True)
        counts, held = np.bincount(where, c, len(keys)).astype(np.int64), []

    for k in range(1, PAIRWISE):
        a = np.flatnonzero(g[:-k] == g[k:]) if len(g) > k else np.zeros(0, int)
        if not len(a):
            break
        a = a[den * np.minimum(n[a], n[a + k]) >= num * np.maximum(n[a], n[a + k])]
        x, y = local[a], local[a + k]
        held.append(np.minimum(x, y) * len(ids) + np.maximum(x, y))
        if sum(map(len, held)) > 2_000_000:
            fold()
    fold()
    x, y = keys // max(len(ids), 1), keys % max(len(ids), 1)
    give_back()
    yield _met("p", u=ids[x], v=ids[y], k=counts, n=sizes[x], n2=sizes[y])


MET = pa.schema([("kind", pa.string()), ("u", pa.int64()), ("v", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("n2", pa.int64()), ("digest", pa.binary())])


def _met(kind: str, **columns) -> pa.RecordBatch:
    """Rows of one kind: d (document: u, n, digest), m (region u, member v) or p (pair u, v with k common cells)."""
    size = len(columns["u"])
    return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.string()), *(pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in list(MET)[1:])], schema=MET)


def _regions(met: DataFrame, num: int, den: int) -> DataFrame:
    """(region, doc_id) of the sets that have to meet.

    Sets of sizes a and b need c common shingles, c = ceil(t(a + b) / (1 + t)).
    Of the two, let x be the one whose first shingles end earlier in the common
    order: its common shingles beyond them are |x| - p_x at most, so it shares
    c - |x| + p_x cells with the other at least.  Pairs with fewer are let go,
    unless they meet in a large cell, which is a region anyway, or have an id
    with several sets, whose sizes aren't told apart here.  One cell less is
    asked for, as two shingles of a set may have one cell key.
    """
    pairs = met.filter("kind = 'p'").groupBy("u", "v").agg(F.sum("k").alias("k"), F.min("n").alias("a"), F.min("n2").alias("b"))
    need = F.ceil((F.col("a") + F.col("b")) * num / F.lit(float(num + den)) - 1e-9)

    def beyond(n: str) -> Column:
        return F.ceil(F.col(n) * num / F.lit(float(den)) - 1e-9) - 1  # |x| - p_x

    enough = F.col("k") + 1 >= need - F.greatest(beyond("a"), beyond("b"))
    several = met.filter("kind = 'd'").groupBy("u").agg(F.count_distinct("digest").alias("sets")).filter("sets > 1").select("u", F.lit(True).alias("s1"))
    if not several.isEmpty():
        pairs = pairs.join(several, "u", "left").join(several.select(F.col("u").alias("v"), F.col("s1").alias("s2")), "v", "left")
        enough = enough | F.coalesce("s1", "s2", F.lit(False))
    pairs = pairs.filter(enough).select("u", "v").checkpoint()
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    met_at = pairs.join(least, "u").join(least.select(F.col("u").alias("v"), F.col("m").alias("m2")), "v")
    region = F.least("m", "m2").alias("region")
    small = met_at.select(region, F.explode(F.array("u", "v")).alias("doc_id"))
    return small.union(met.filter("kind = 'm'").select("u", "v")).distinct()


# One region -------------------------------------------------------------------


class Region:
    """The sets of a region side by side, and which are known to be connected."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], num: int = NUM, den: int = DEN):
        self.ids, self.num, self.den = ids, num, den
        self.sets = sets
        self.n = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.ends = np.concatenate([[0], np.cumsum(self.n)])
        self.parent = list(range(len(ids)))
        self.edges: list[tuple[int, int]] = []
        self.reach = 1 - num / den

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def common(self, p: int, some: np.ndarray) -> np.ndarray:
        """Common shingles of set p with some others."""
        if len(some) == len(self.n):
            flat, ends = self.flat, self.ends
        else:
            flat = np.concatenate([self.sets[i] for i in some]) if len(some) else self.flat[:0]
            ends = np.concatenate([[0], np.cumsum(self.n[some])])
        own = self.sets[p]
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        return np.diff(np.concatenate([[0], np.cumsum(hit)])[ends])

    def meet(self, p: int, some: np.ndarray) -> np.ndarray:
        """Distances of p to some others; links what is near."""
        both = self.common(p, some)
        for i in some[linked(both, self.n[p], self.n[some], self.num, self.den)].tolist():
            a, b = self.root(p), self.root(i)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.edges.append((p, i))
        return 1 - both / (self.n[p] + self.n[some] - both)

    def join(self, members: np.ndarray, depth: int = 0, pivots: int = 6, leaf: int = 24) -> None:
        """Connect all links among members, by Voronoi cells with windows."""
        if len(members) > leaf and depth < 6:
            chosen, nearest = [int(members[0])], None
            rows = []
            for _ in range(pivots):
                d = self.meet(chosen[-1], members)
                rows.append(d)
                nearest = d if nearest is None else np.minimum(nearest, d)
                if nearest.max() <= self.reach or len({self.root(int(i)) for i in members}) == 1:
                    break
                chosen.append(int(members[nearest.argmax()]))
            if len({self.root(int(i)) for i in members}) == 1:
                return
            distance = np.stack(rows)
            own = distance.argmin(0)
            least = distance.min(0)
            if len(rows) > 1 and all(((distance[j] - least) <= 2 * self.reach + 1e-9).sum() < 0.8 * len(members) for j in range(len(rows))):
                for j in range(len(rows)):
                    if (own == j).any():
                        self.join(members[distance[j] - least <= 2 * self.reach + 1e-9], depth + 1, pivots, leaf)
                return
            self.sweep(members, distance)
        else:
            self.sweep(members, np.zeros((1, len(members))))

    def sweep(self, members: np.ndarray, distance: np.ndarray) -> None:
        """All pairs that sizes, triangle bounds and what is connected leave open, in order of size."""
        order = np.argsort(self.n[members], kind="stable")
        members, distance = members[order], distance[:, order]
        n = self.n[members]
        top = np.searchsorted(self.den * n, 1 + (self.den * self.den * n) // self.num)  # sizes up to n / t
        for k in range(len(members) - 1):
            last = max(int(top[k]), k + 1)
            if last == k + 1:
                continue
            rest = slice(k + 1, last)
            fine = (np.abs(distance[:, rest] - distance[:, k : k + 1]) <= self.reach + 1e-9).all(0)
            open_ = members[rest][fine]
            me = self.root(int(members[k]))
            open_ = np.array([i for i in open_.tolist() if self.root(i) != me], np.int64)
            if len(open_):
                self.meet(int(members[k]), open_)


def _blob_set(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u8")


def _join_regions(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of regions whose rows come one region after another."""
    region, ids, sets, out = None, [], [], []

    def close():
        if len(ids) > 1:
            r = Region(np.array(ids), sets, num, den)
            r.join(np.arange(len(ids)))
            out.extend((ids[a], ids[b]) for a, b in r.edges)

    for batch in batches:
        for key, doc, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != region:
                close()
                region, ids, sets = key, [], []
            ids.append(doc)
            sets.append(_blob_set(blob))
        if out:
            yield record("", u=[a for a, _ in out], v=[b for _, b in out])
            out.clear()
    close()
    if out:
        yield record("", u=[a for a, _ in out], v=[b for _, b in out])
    give_back()


def _join_counted(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row a key, whose ``c`` is how many of the rows have it; hot keys don't shuffle.

    No more than ``total`` / (the least count of a hot key) keys are hot.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot, cold = keys.filter(F.col("c") > least).drop("c"), keys.filter(F.col("c") <= least).drop("c")
    near = F.broadcast(hot)
    return rows.join(near, key).union(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


# Regions too large for a task ---------------------------------------------------


STATE = "region long, doc_id long, blob binary, d array<double>, label long, near array<long>"


def _distances(pivots, num: int, den: int):
    """Adds each member's distances to its region's pivots, and the pivots near it."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            far, near = [], []
            for region, blob, d in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                own = _blob_set(blob)
                some = pivots.value.get(region, [])
                both = [int(np.isin(p, own, assume_unique=True).sum()) for _, p in some]
                far.append([*d, *(1 - b / (len(p) + len(own) - b) for b, (_, p) in zip(both, some, strict=True))])
                near.append([q for b, (q, p) in zip(both, some, strict=True) if linked(b, len(p), len(own), num, den)])
            return record("", region=batch.column(0), doc_id=batch.column(1), blob=batch.column(2), d=pa.array(far, pa.list_(pa.float64())), label=batch.column(4), near=pa.array(near, pa.list_(pa.int64())))

        return step

    return make


def _merged(same: list) -> list[tuple[int, int, int]]:
    """(region, label, least label of its component) from pairs of labels that are one component."""
    parent: dict[tuple[int, int], int] = {}

    def root(region: int, x: int) -> int:
        while parent.get((region, x), x) != x:
            x = parent[region, x]
        return x

    for r in same:
        a, b = root(r.region, r.a), root(r.region, r.b)
        if a != b:
            parent[r.region, max(a, b)] = min(a, b)
    return [(region, x, root(region, x)) for region, x in sorted({(r.region, y) for r in same for y in (r.a, r.b)})]


def _crossed(members: pd.DataFrame, rest: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Links between some members of a region and some of its unsettled ones."""
    u, v = [], []
    if len(members) and len(rest):
        region = Region(members["doc_id"].to_numpy(), [_blob_set(b) for b in members["blob"]], num, den)
        d = np.stack(members["d"].to_numpy()) if len(members["d"].iloc[0]) else np.zeros((len(members), 0))
        label = members["label"].to_numpy(float)
        for doc, blob, own, mine in zip(rest["doc_id"], rest["blob"], rest["d"], rest["label"].to_numpy(float), strict=True):
            some = np.flatnonzero((np.abs(d - np.asarray(own)[None, :]) <= region.reach + 1e-9).all(1) & (region.ids != doc) & ~(label == mine))
            p = _blob_set(blob)
            flat = np.concatenate([region.sets[i] for i in some]) if len(some) else region.flat[:0]
            ends = np.concatenate([[0], np.cumsum(region.n[some])])
            hit = p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat
            both = np.diff(np.concatenate([[0], np.cumsum(hit)])[ends])
            near = some[linked(both, len(p), region.n[some], num, den)]
            u += [doc] * len(near)
            v += region.ids[near].tolist()
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def _join_large(members: DataFrame, num: int, den: int, pivots: int = 8, rounds: int = 4, part: int = 512) -> DataFrame:
    """Links that connect the members (region, doc_id, blob) of regions of any size.

    The regions are LARGE_REGIONS or about so many.  Only pivots come to the
    driver, about ``pivots`` a region and round, and which of them are one
    component, as far as a member is near to two of them.
    """
    spark = members.sparkSession
    state = members.select("region", "doc_id", "blob", F.array().cast("array<double>").alias("d"), F.lit(None).cast("long").alias("label")).checkpoint()
    links = None
    for turn in range(rounds):
        open_ = state.filter("label is null")
        sizes = open_.groupBy("region").agg(F.count("*").alias("open"))
        few = open_.join(sizes, "region").filter(F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.col("open")) < 2 * pivots).select("region", "doc_id", "blob")
        chosen: dict[int, list] = {}
        for r in few.collect():
            chosen.setdefault(r.region, []).append((r.doc_id, _blob_set(r.blob)))
        if not chosen:
            break
        shared = spark.sparkContext.broadcast({region: sorted(p, key=lambda x: x[0])[:pivots] for region, p in chosen.items()})
        met = state.mapInArrow(per_batch(_distances(shared, num, den)), STATE).checkpoint()
        some = met.select(F.col("doc_id").alias("u"), F.explode("near").alias("v"))
        links = some if links is None else links.union(some)
        # pivots near one member, and its label of an earlier round, are one component
        same = met.filter(F.size("near") > 0).select("region", F.coalesce("label", F.col("near")[0]).alias("a"), F.explode("near").alias("b")).distinct().collect()
        merged = F.broadcast(spark.createDataFrame(_merged(same), "region long, x long, to long"))
        met = met.withColumn("x", F.coalesce("label", F.get("near", F.lit(0))))
        state = met.join(merged, ["region", "x"], "left").select("region", "doc_id", "blob", "d", F.coalesce("to", "x").alias("label")).checkpoint()
        if state.filter("label is null").limit(part + 1).count() <= part:
            break
    # in each region the most common component is settled; all others meet everything, part by part
    counts = state.groupBy("region", "label").count()
    main = counts.filter("label is not null").groupBy("region").agg(F.max_by("label", "count").alias("main"))
    rest = state.join(F.broadcast(main), "region", "left").filter("label is null or label <> main").drop("main")
    # a region is cut by its own size and its own number of unsettled members
    sizes = counts.groupBy("region").agg(F.sum("count").alias("n")).join(rest.groupBy("region").agg(F.count("*").alias("r")), "region")
    sizes = F.broadcast(sizes.select("region", F.ceil(F.col("n") / part).alias("parts"), F.ceil(F.col("r") / part).alias("blocks")))

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = state.join(sizes, "region").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).withColumn("block", each("blocks")).drop("parts", "blocks")
    right = rest.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(1)), "blocks")).withColumn("part", each("parts")).drop("parts", "blocks")
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns apart from those of the left side
    keys = ["region", "part", "block"]
    cross = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(partial(_crossed, num=num, den=den), "u long, v long")
    return cross if links is None else links.union(cross)


# Over a table -------------------------------------------------------------------


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = NUM, den: int = DEN, region_most: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    docs = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    lost = docs.filter("doc_id is null")
    known = docs.filter("doc_id is not null")
    # about one shingle for seven bytes of text
    places = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n // 7
    parts = int(max(1, spark.sparkContext.defaultParallelism, places // 4 // CELL_ROWS))
    common = common_shingles(known, width, parts)
    order = np.argsort(common, kind="stable")
    shared = spark.sparkContext.broadcast((common[order], order))
    dealt = known.mapInArrow(per_batch(lambda: lambda batch: _cells(batch, shared.value, width, parts, num, den)), "part int, doc_id long, n long, digest binary, rows long, blob binary")
    met = dealt.repartitionById(parts, F.col("part")).mapInArrow(partial(_meetings, num=num, den=den), "kind string, u long, v long, k long, n long, n2 long, digest binary").checkpoint()
    rows = met.filter("kind = 'd'").select(F.col("u").alias("doc_id"), "n", "digest")
    members = _regions(met, num, den)
    members = members.join(members.groupBy("region").agg(F.count("*").alias("size")), "region").filter("size > 1").checkpoint()
    # the sets of the members; each goes to its regions
    places_of = members.groupBy("doc_id").agg(F.collect_list(F.struct("region", "size")).alias("regions"))
    places_of = F.broadcast(places_of) if members.count() <= BROADCAST_ROWS else places_of

    def sets():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, ends = _sets(texts(batch, "text"), width)
            blob = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 8).astype("<i8").tobytes()), pa.py_buffer(flat.astype("<u8").tobytes())])
            regions = batch.column(2)
            at = pa.compute.list_parent_indices(regions)
            each = regions.flatten()
            return record("", region=each.field(0), doc_id=batch.column(0).take(at), blob=blob.take(at).cast(pa.binary()), size=each.field(1))

        return step

    dealt = known.join(places_of, "doc_id").select("doc_id", "text", "regions").mapInArrow(per_batch(sets), "region long, doc_id long, blob binary, size long")
    small = dealt
    links = None
    if not members.filter(F.col("size") > region_most).isEmpty():
        large = dealt.filter(F.col("size") > region_most).select("region", "doc_id", "blob").dropDuplicates(["region", "doc_id", "blob"])
        slices = max(1, -(-members.filter(F.col("size") > region_most).select("region").distinct().count() // LARGE_REGIONS))
        for k in range(slices):
            some = _join_large(large.filter(F.pmod(F.xxhash64("region"), F.lit(slices)) == k), num, den)
            links = some if links is None else links.union(some)
        small = dealt.filter(F.col("size") <= region_most)
    ordered = small.select("region", "doc_id", "blob").repartition(max(parts, 2), "region").sortWithinPartitions("region", "doc_id")
    near = ordered.mapInArrow(partial(_join_regions, num=num, den=den), "u long, v long")
    links = near if links is None else links.union(near)
    # copies are joined by digest, rows of one doc_id by it; a hot digest, id or component doesn't meet in one task
    total = rows.count()
    copies = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("rep"))
    rows = _join_counted(rows.filter("n > 0"), copies, "digest", total).select("doc_id", "n", "rep").union(alone).checkpoint()
    reps = rows.groupBy("doc_id", "rep").agg(F.count("*").alias("rows"))
    rep = reps.groupBy("doc_id").agg(F.min("rep").alias("least"), F.count("*").alias("c")).checkpoint()
    repeated = _join_counted(reps.select("doc_id", "rep"), rep.filter("c > 1"), "doc_id", total).filter("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    links = links.distinct().join(rep.select(F.col("doc_id").alias("u"), F.col("least").alias("ru")), "u").join(rep.select(F.col("doc_id").alias("v"), F.col("least").alias("rv")), "v")
    found = components(links.select(F.col("ru").alias("u"), F.col("rv").alias("v")).union(repeated))
    own = reps.groupBy("rep").agg(F.sum("rows").alias("c")).join(found, F.col("rep") == F.col("node"), "left").select("rep", "c", F.coalesce("component", "rep").alias("component_id"))
    out = _join_counted(rows, own, "rep", total).select("doc_id", F.col("n").alias("n_shingles"), "component_id")

    def count():
        return lambda batch: record("", doc_id=batch.column(0), n_shingles=np.diff(_sets(texts(batch, "text"), width)[1]).astype(np.int64), component_id=pa.nulls(batch.num_rows, pa.int64()))

    return out.union(lost.mapInArrow(per_batch(count), "doc_id long, n_shingles long, component_id long"))
