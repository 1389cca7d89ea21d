"""Language-model scoring with a causal self-attention model on subword ids.

A text is lower-cased (A-Z) and read as words; each word, with a blank before
it, becomes byte-level subword ids of a public vocabulary, and one end id
closes the text.  Since the vocabulary never joins across a blank, the ids
determine the words, so the probability of the ids is that of the words.

The model has one attention layer: embeddings, queries, keys and values, a bias
for each distance, a tanh layer over attention output and the last embedding,
and a softmax over classes of ids.  Within its class an id has its share of
what follows the id before it in all training texts, smoothed by what follows
that id's class, smoothed by the id's own share.  Weights are
trained in numpy: first on windows drawn from the whole training corpus, to have
one model to go on from, then in every partition on the windows of all training
texts, after which the partitions' weights are averaged.  An id's embedding is
averaged by how often each partition met it.  All counts cover all texts.

Scoring runs over blocks of ``STRIDE`` tokens, each in a window that also holds
the ``STRIDE`` tokens before it, batched with causal and padding masks: every
token is scored exactly once, with at least ``STRIDE`` tokens of context
where the text has them.

The base score is that of add-one word counts.  Words in the table that is
broadcast (the most frequent ones, ``BROADCAST_WORDS`` at most) are looked up
in place; rarer ones are joined with the full count table by shuffle.  So it is
with neighbouring ids: totals by id and class are summed over all pairs, the
most frequent pairs (``BROADCAST_PAIRS`` at most) are looked up in place, and
the counts of the others are joined by shuffle.

Defined cases: a null text is empty, which still has its end token; repeated
rows are scored alike and, in training, counted each; without training texts
N = V = 0 and the model is untrained; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import copy
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches, give_back, only, per_batch, record, row_of, scratch, segment_sum, texts, word_hashes, words
from .pieces import Table

STRIDE, WIDTH = 16, 16
HIDDEN, CLASSES, FREQUENT = 28, 128, 100
#: Weight of the coarser share when shares are smoothed: by class, by id.
BY_CLASS, BY_ID = 60.0, 10.0
#: Documents and windows of the first training, on the driver, at most; drawn by hash from all training texts.
FIT_DOCS, FIT_WINDOWS = 4500, 60_000
#: Windows of a training step; pace of the first one, and the part of it that the last and all later ones have.
STEP_WINDOWS, PACE, SLOWEST = 64, 0.03, 0.1
#: Embeddings that are averaged together.
AVERAGED = 1024
#: Word counts that are broadcast at most.
BROADCAST_WORDS = 1_500_000
CACHED_WORDS = 250_000
#: Pairs of neighbouring ids that are broadcast at most, those seen most often; the others are joined.
BROADCAST_PAIRS = 2_000_000
#: How far back in a window a token sees another, and whether it does.
_GAP = np.maximum(np.arange(2 * STRIDE)[:, None] - np.arange(2 * STRIDE)[None, :], 0)
_CAUSAL = np.tri(2 * STRIDE, dtype=bool)


class Subwords:
    """Ids of words by a byte-level vocabulary; keeps the words it has seen first."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        self.opens = np.zeros(self.end + 1, bool)
        self.opens[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True
        self.coder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, bytes] = {}

    def _together(self, words: list[str]) -> list[bytes] | None:
        """Encode words as one text; a word starts where a piece starts with a blank."""
        ids = np.array(self.coder.encode_ordinary(" " + " ".join(words)), np.int32)
        starts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
        if len(starts) != len(words):
            return None
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]

    def __call__(self, dictionary: list[str]) -> list[bytes]:
        """The ids of each word as bytes."""
        kept = self.kept
        new = [w for w in dictionary if w not in kept]
        got: dict[str, bytes] = {}
        # white space of other kinds would join across words
        odd = pc.match_substring_regex(pa.array(new, pa.string()), r"[\p{Z}\x{85}\x00-\x1f]").to_numpy(zero_copy_only=False)
        plain = [w for w, o in zip(new, odd, strict=True) if not o]
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            lists = self._together(some)
            if lists:
                got.update(zip(some, lists, strict=True))
        for w in new:
            if w not in got:
                got[w] = array("i", self.coder.encode_ordinary(" " + w)).tobytes()
        out = [got[w] if w in got else kept[w] for w in dictionary]
        if len(kept) < CACHED_WORDS:
            kept.update(got)
        return out


@cache
def subwords(path: str) -> Subwords:
    return Subwords(path)


class Batch:
    """The ids of rows of words, with an end id after each row; words' ids are kept once in ``pool``."""

    def __init__(self, path: str, codes: np.ndarray, offsets: np.ndarray, dictionary: pa.Array):
        coder = subwords(path)
        lists = coder(dictionary.to_pylist())
        self.codes, self.offsets, self.end = codes, offsets, coder.end
        self.size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        self.pool = np.frombuffer(b"".join(lists), np.int32)
        self.first = np.cumsum(self.size) - self.size
        per = self.size[codes]
        self.ends = np.concatenate([[0], np.cumsum(segment_sum(per, offsets) + 1)])
        self.ids = np.full(int(self.ends[-1]), coder.end, np.int32)
        to = np.ones(len(self.ids), bool)
        to[self.ends[1:] - 1] = False
        stop = np.cumsum(per)
        self.ids[to] = self.pool[np.repeat(self.first[codes] - (stop - per), per) + np.arange(int(stop[-1]) if len(stop) else 0)]

    def inner(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring ids inside the distinct words, and the word that each pair is in."""
        word = np.repeat(np.arange(len(self.size)), self.size)
        same = np.flatnonzero(word[1:] == word[:-1])
        return self.pool[same], self.pool[same + 1], word[same]

    def outer(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring ids across words and row ends, and the row that each pair is in."""
        n = np.diff(self.offsets)
        last, head = self.pool[self.first + self.size - 1], self.pool[self.first]
        ends = self.offsets + np.arange(len(self.offsets))
        left, right = (np.full(int(ends[-1]), self.end, np.int32) for _ in range(2))
        row = np.repeat(np.arange(len(n)), n + 1)
        inside = np.ones(len(left), bool)
        inside[ends[1:] - 1] = False
        right[inside] = head[self.codes]
        inside[:] = True
        inside[ends[:-1]] = False
        left[inside] = last[self.codes]
        return left, right, row

    def pair_counts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (left * size + right) and how often they occur in the rows."""
        a, b, word = self.inner()
        often = np.bincount(self.codes, minlength=len(self.size))[word]
        c, d, _ = self.outer()
        key = np.concatenate([a, c]).astype(np.int64) * size + np.concatenate([b, d])
        found, where = np.unique(key, return_inverse=True)
        return found, np.bincount(where, np.concatenate([often, np.ones(len(c))]), len(found)).astype(np.int64)


def token_ids(path: str, codes: np.ndarray, offsets: np.ndarray, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    batch = Batch(path, codes, offsets, dictionary)
    return batch.ids, batch.ends


def blocks(ids: np.ndarray, ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, places, first, row): inputs are the ids shifted by one with the end id before each
    row; a block's window is places -stride to stride - 1 around it; first marks a row's first block."""
    n = np.diff(ends)
    inputs = np.concatenate([[0], ids[:-1]]).astype(np.int32) if len(ids) else ids
    inputs[ends[:-1]] = ids[ends[1:] - 1]
    count = -(-n // stride)
    stop = np.cumsum(count)
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - count, count)
    return inputs, ends[:-1][row] + nth * stride, nth == 0, row


def pair_keys(classes: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each pair counts for: (class before, id), and (id before, class)."""
    left, right = pairs // len(classes), pairs % len(classes)
    return classes[left] * len(classes) + right, left * CLASSES + classes[right]


def class_sums(classes: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by (class before, id) and by (id before, class)."""
    return tuple(np.bincount(k, counts, CLASSES * len(classes)) for k in pair_keys(classes, pairs))


def cut_windows(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Windows of 2 * STRIDE + 1 ids that hold every id of each row once as a target; -1 fills up the last one of a row."""
    length = 2 * STRIDE
    n = np.diff(ends)
    count = -(-n // length)
    row = row_of(np.concatenate([[0], np.cumsum(count)]))
    at = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))[:, None] * length + np.arange(length + 1)
    place = ends[:-1][row][:, None] + at - 1
    place[at == 0] = ends[1:][row[(at == 0).any(1)]] - 1  # the end id stands before each row
    return np.where(at <= n[row][:, None], ids[np.minimum(place, len(ids) - 1)], -1).astype(np.int64) if len(ids) else np.zeros((0, length + 1), np.int64)


def context_keys(counts: np.ndarray, pairs: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place * 514 + slot of a neighbour, count) for each side of pairs of ids that are neither frequent nor rare."""
    rank = np.argsort(-counts, kind="stable")
    slot, place = np.full(len(counts), 256, np.int64), np.full(len(counts), -1, np.int64)
    slot[rank[:256]] = np.arange(256)
    mid = _middle(counts)
    place[mid] = np.arange(len(mid))
    a, b = pairs // len(counts), pairs % len(counts)
    right, left = np.flatnonzero(place[b] >= 0), np.flatnonzero(place[a] >= 0)
    key = np.concatenate([place[b[right]] * 514 + slot[a[right]], place[a[left]] * 514 + 257 + slot[b[left]]])
    return key, np.concatenate([often[right], often[left]])


def _middle(counts: np.ndarray) -> np.ndarray:
    mid = np.argsort(-counts, kind="stable")[FREQUENT : FREQUENT + 6000]
    return mid[counts[mid] > 0]


class Shares:
    """P(id | its class, the id before it) from counts of neighbouring ids.

    ``sums`` are those of ``class_sums`` over all pairs; without them, ``pairs`` are all there are.
    """

    def __init__(self, classes: np.ndarray, pairs: np.ndarray, counts: np.ndarray, sums: tuple[np.ndarray, np.ndarray] | None = None):
        size = len(classes)
        left, right = pairs // size, pairs % size
        table, follow = sums or class_sums(classes, pairs, counts)
        table = table.reshape(CLASSES, size)
        own = table.sum(0) + 0.1
        share = own / np.bincount(classes, own, CLASSES)[classes]
        before, into = classes[left], classes[right]
        total = np.stack([np.bincount(classes, t, CLASSES) for t in table])
        table = (table + BY_CLASS * share) / (total[:, classes] + BY_CLASS)
        self.size, self.classes = size, classes
        value = np.log((counts + BY_ID * table[before, right]) / (follow[left * CLASSES + into] + BY_ID))
        self.seen = Table((pairs, np.arange(len(pairs))))
        self.value = value.astype(np.float32)
        self.coarse = np.log(table).astype(np.float32).ravel()
        self.follow = np.log(BY_ID / (follow + BY_ID)).astype(np.float32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.look(left, right)[0]

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Natural log shares, as of count 0 where a pair isn't in the table; the places, pairs and coarse shares of those.

        A pair of which the count is c after all gains log(1 + c / (BY_ID * its coarse share)).
        """
        left = left.astype(np.int64)
        at = self.seen(left * self.size + right)
        out = self.value[at] if len(self.value) else np.zeros(len(left), np.float32)
        new = np.flatnonzero(at < 0)
        a, b = left[new], right[new]
        coarse = self.coarse[self.classes[a] * self.size + b]
        out[new] = coarse + self.follow[a * CLASSES + self.classes[b]]
        return out, new, a * self.size + b, coarse


@dataclass
class AttentionModel:
    """Weights by name, each id's class, and the shares of ids in their classes."""

    weights: dict[str, np.ndarray]
    classes: np.ndarray
    shares: Shares

    def tables(self) -> None:
        """With one layer, queries, keys, values and the residual depend on the id alone."""
        w = self.weights
        e = w["embed"]
        self.query = (e @ w["query"] / np.sqrt(WIDTH)).astype(np.float32)
        self.key, self.value = (e @ w["key"]).astype(np.float32), (e @ w["value"]).astype(np.float32)
        # a value that is always 1 gathers the sum of the attention weights
        self.value = np.concatenate([self.value, np.ones((len(e), 1), np.float32)], 1)
        self.ones = np.ones(CLASSES, np.float32)
        self.mix = w["mix"].astype(np.float32)
        self.rest = (e @ w["rest"] + w["shift"]).astype(np.float32)
        i, j = np.arange(STRIDE)[:, None] + STRIDE, np.arange(2 * STRIDE)[None, :]
        self.bias = np.where(i >= j, w["bias"][np.maximum(i - j, 0)], np.float32(-1e4)).astype(np.float32)
        # the shift of the logits is a weight of a hidden unit that is always 1
        self.out = np.concatenate([w["out"], w["lift"][None, :]]).astype(np.float32)
        # exponents that can't overflow need no clipping
        reach = np.linalg.norm(self.query, axis=1).max() * np.linalg.norm(self.key, axis=1).max() + np.abs(w["bias"]).max()
        self.safe = bool(reach < 60), bool(np.abs(self.out).sum(0).max() < 80)

    def block_scores(self, inputs: np.ndarray, targets: np.ndarray, start: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Natural log probability of the classes of each block's targets."""
        at = start[:, None] + np.arange(-STRIDE, STRIDE)
        live = at[:, STRIDE:] < stop[:, None]
        np.clip(at, 0, len(inputs) - 1, out=at)
        x = inputs[at]
        own = x[:, STRIDE:]
        s = np.matmul(self.query.take(own, 0), self.key.take(x, 0).transpose(0, 2, 1))
        s += self.bias
        s[first, :, :STRIDE] = -1e4
        if not self.safe[0]:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        seen = np.matmul(s, self.value.take(x, 0))
        seen = seen[:, :, :WIDTH] / seen[:, :, WIDTH:]
        # products block by block: in one product of all rows, rounding depends on where a row stands
        hidden = np.ones((*own.shape, HIDDEN + 1), np.float32)
        mixed = np.matmul(seen, self.mix)
        mixed += self.rest.take(own, 0)
        np.tanh(mixed, out=hidden[:, :, :HIDDEN])
        logits = np.matmul(hidden, self.out).reshape(-1, CLASSES)
        y = targets[at[:, STRIDE:]].ravel()
        picked = logits[np.arange(len(y)), self.classes[y]]
        if not self.safe[1]:
            np.minimum(logits, 80, out=logits)
        np.exp(logits, out=logits)
        logp = picked - np.log(logits @ self.ones)
        return np.where(live.ravel(), logp, 0).reshape(live.shape).sum(1, dtype=np.float64)

    def score(self, batch: Batch, step: int = 128) -> np.ndarray:
        """log10 probability of each row."""
        return self.score_known(batch, step)[0]

    def score_known(self, batch: Batch, step: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each row by the pairs in the table; row, pair and coarse share of every occurrence of another pair."""
        if not hasattr(self, "query"):
            self.tables()
        ids, ends = batch.ids, batch.ends
        inputs, start, first, row = blocks(ids, ends)
        stop = ends[1:][row]
        parts = [self.block_scores(inputs, ids, start[k : k + step], first[k : k + step], stop[k : k + step]) for k in range(0, len(start), step)]
        flat = np.concatenate(parts) if parts else np.zeros(0)
        total = segment_sum(flat, np.searchsorted(row, np.arange(len(ends))))
        left, right, word = batch.inner()
        share, new, pair, coarse = self.shares.look(left, right)
        inner = np.bincount(word, share, len(batch.size))
        total += segment_sum(inner[batch.codes], batch.offsets)
        # pairs of a word are in order of the words, and occur wherever the word does
        per = np.bincount(word[new], minlength=len(batch.size))
        first, n = np.cumsum(per) - per, per[batch.codes]
        stop = np.cumsum(n)
        at = np.repeat(first[batch.codes] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)
        rows = np.repeat(row_of(batch.offsets), n)
        left, right, row = batch.outer()
        share, new, pair_, coarse_ = self.shares.look(left, right)
        rows, pair, coarse = np.concatenate([rows, row[new]]), np.concatenate([pair[at], pair_]), np.concatenate([coarse[at], coarse_])
        order = np.argsort(rows, kind="stable")
        return (total + np.bincount(row, share, len(total))) / np.log(10), rows[order], pair[order], coarse[order]


def id_classes(feature: np.ndarray, counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """A class for each id: frequent ids alone, other seen ids by k-means on counts of their neighbours, the rest by a hash."""
    n = len(counts)
    out = np.full(n, -1, np.int64)
    out[np.argsort(-counts, kind="stable")[:FREQUENT]] = np.arange(FREQUENT)
    groups = CLASSES - FREQUENT - 8
    mid = _middle(counts)
    feature = feature[: len(mid) * 514].reshape(-1, 514)
    feature = np.log1p(feature)
    feature /= np.maximum(np.linalg.norm(feature, axis=1, keepdims=True), 1e-9)
    if len(mid) > groups:
        draw = np.random.default_rng(seed)
        centers = feature[draw.choice(min(len(mid), 1500), groups, replace=False)]
        for _ in range(8):
            nearest = (feature @ centers.T).argmax(1)
            for g in range(groups):
                if (nearest == g).any():
                    centers[g] = feature[nearest == g].mean(0)
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
        out[mid] = FREQUENT + (feature @ centers.T).argmax(1)
    else:
        out[mid] = FREQUENT + np.arange(len(mid))
    rest = np.flatnonzero(out < 0)
    out[rest] = CLASSES - 8 + rest % 8
    return out


def _rows(table: np.ndarray) -> np.ndarray:
    """Each row of a table as one item, which is written at once."""
    return table.view(np.dtype((np.void, table.itemsize * table.shape[1])))[:, 0]


class Learner:
    """Weights with the running moments of their gradients: Adam, and Adagrad for the embeddings."""

    def __init__(self, n: int, share: np.ndarray, seed: int):
        draw = np.random.default_rng(seed)

        def init(*shape: int) -> np.ndarray:
            return draw.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.w = {
            "embed": draw.normal(0, 0.3, (n, WIDTH)).astype(np.float32), "query": init(WIDTH, WIDTH), "key": init(WIDTH, WIDTH), "value": init(WIDTH, WIDTH), "mix": init(WIDTH, HIDDEN),
            "rest": init(WIDTH, HIDDEN), "shift": np.zeros(HIDDEN, np.float32), "bias": np.zeros(2 * STRIDE, np.float32), "out": init(HIDDEN, CLASSES) * 0.5, "lift": np.log(share / share.sum()).astype(np.float32),
        }
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items() if k != "embed"}
        self.met = np.zeros((n, WIDTH), np.float32)
        self.done, self.draw = 0, draw

    def step(self, windows: np.ndarray, classes: np.ndarray, pace: float) -> None:
        """One step on windows of ids, of which those below 0 are no targets."""
        w, length = self.w, 2 * STRIDE
        live = windows[:, 1:] >= 0
        windows = np.maximum(windows, 0)
        x, y = windows[:, :-1].ravel(), classes[windows[:, 1:]].ravel()
        n, wide, every = len(windows), (-1, length, WIDTH), np.arange(len(y))
        root = np.float32(1 / np.sqrt(WIDTH))
        e = w["embed"].take(x, 0)
        front = e @ np.concatenate([w["query"] * root, w["key"], w["rest"]], 1)
        q, k = front[:, :WIDTH].reshape(wide), front[:, WIDTH : 2 * WIDTH].reshape(wide)
        # a value that is always 1 gathers the sum of the attention weights, which stay undivided
        v = np.ones((len(x), WIDTH + 1), np.float32)
        np.matmul(e, w["value"], out=v[:, :WIDTH])
        v = v.reshape(n, length, WIDTH + 1)
        a = q @ k.transpose(0, 2, 1)
        a += np.where(_CAUSAL, w["bias"][_GAP], np.float32(-1e4))
        own = a.diagonal(0, 1, 2)  # no row is all below its own token
        if a.max() > 60 or own.min() < -60:  # sums that neither overflow nor vanish need no shift
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        o = (a @ v).reshape(-1, WIDTH + 1)
        part = 1 / o[:, WIDTH:]
        o = o[:, :WIDTH] * part
        # the shift of the logits is a weight of a hidden unit that is always 1
        h = np.ones((len(x), HIDDEN + 1), np.float32)
        mixed = o @ w["mix"]
        mixed += front[:, 2 * WIDTH :]
        mixed += w["shift"]
        hidden = np.tanh(mixed, out=mixed)
        h[:, :HIDDEN] = hidden
        last = np.concatenate([w["out"], w["lift"][None, :]])
        p = h @ last
        if np.abs(last).sum(0).max() > 80:
            p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        total = p @ np.ones(CLASSES, np.float32)
        p[every, y] -= total
        # rows of p are divided where they have fewer columns
        each = (live.ravel() / (total * np.float32(live.sum())))[:, None].astype(np.float32)
        d = np.empty((len(x), 3 * WIDTH + HIDDEN), np.float32)
        dq, dk, dv, dh = (d[:, i : i + m] for i, m in ((0, WIDTH), (WIDTH, WIDTH), (2 * WIDTH, WIDTH), (3 * WIDTH, HIDDEN)))
        np.multiply(p @ w["out"].T, each, out=dh)
        dh *= 1 - hidden * hidden
        h *= each
        out = h.T @ p
        do = np.empty((len(x), WIDTH + 1), np.float32)
        np.matmul(dh, w["mix"].T, out=do[:, :WIDTH])
        # what a row of attention weights gets on average is do * o
        do[:, WIDTH] = -np.einsum("ij,ij->i", do[:, :WIDTH], o)
        do *= part
        do = do.reshape(n, length, WIDTH + 1)
        dv[:] = (a.transpose(0, 2, 1) @ do[:, :, :WIDTH]).reshape(-1, WIDTH)
        ds = do @ v.transpose(0, 2, 1)
        ds *= a
        np.multiply((ds @ k).reshape(-1, WIDTH), root, out=dq)
        dk[:] = (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)
        de = d @ np.concatenate([w["query"], w["key"], w["value"], w["rest"]], 1).T
        back = e.T @ d
        g = {
            "query": back[:, :WIDTH], "key": back[:, WIDTH : 2 * WIDTH], "value": back[:, 2 * WIDTH : 3 * WIDTH], "mix": o.T @ dh, "rest": back[:, 3 * WIDTH :], "shift": dh.sum(0), "out": out[:HIDDEN], "lift": out[HIDDEN],
            "bias": np.bincount(_GAP[_CAUSAL], ds.sum(0)[_CAUSAL], length).astype(np.float32),
        }
        self.done += 1
        pace = np.float32(pace)
        for name, grad in g.items():
            m, u = self.moment[name]
            m += 0.1 * (grad - m)
            u += 0.01 * (grad * grad - u)
            w[name] -= pace * (m / (1 - 0.9**self.done)) / (np.sqrt(u / (1 - 0.99**self.done)) + 1e-7)
        order = np.argsort(x, kind="stable")
        x = x[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        seen, grad = x[first], np.add.reduceat(de[order], first, axis=0)
        met = self.met.take(seen, 0) + grad * grad
        _rows(self.met)[seen] = _rows(met)
        _rows(w["embed"])[seen] = _rows(w["embed"].take(seen, 0) - np.float32(5) * pace * grad / (np.sqrt(met) + np.float32(1e-7)))

    def learn(self, windows: np.ndarray, classes: np.ndarray, passes: int, batch: int = STEP_WINDOWS, rate: float = PACE, fall: bool = True) -> None:
        """Passes over windows in a drawn order; the pace falls to its slowest part, or is that from the start."""
        each = -(-len(windows) // batch)
        done = 0
        for _ in range(passes if len(windows) else 0):
            for some in np.array_split(self.draw.permutation(len(windows)), each):
                done += 1
                self.step(windows[some], classes, rate * (1 - (1 - SLOWEST) * done / (passes * each)) if fall else rate * SLOWEST)


def train(windows: np.ndarray, pairs: np.ndarray, often: np.ndarray, n: int, passes: int = 0, batch: int = STEP_WINDOWS, rate: float = PACE, seed: int = 3, every: tuple[np.ndarray, np.ndarray, tuple] | None = None, more: Callable[[Learner, np.ndarray], None] | None = None) -> AttentionModel:
    """Train on rows of 2 * STRIDE + 1 ids below n; ``often`` counts the neighbouring ids of all training texts.

    If ``pairs`` aren't all, ``every`` holds the ids' counts, classes and ``class_sums`` over all of them.
    ``more`` goes on with the learner.
    """
    passes = passes or max(5, min(14, 360_000 // max(len(windows), 1)))
    counts, classes, sums = every or (np.bincount(pairs % n, often, n), None, None)
    if classes is None:
        classes = id_classes(np.bincount(*context_keys(counts, pairs, often), 6000 * 514), counts)
    learner = Learner(n, np.bincount(classes, counts, CLASSES) + 1, seed)
    learner.learn(windows, classes, passes, batch, rate)
    if more:
        more(learner, classes)
    return AttentionModel(learner.w, classes, Shares(classes, pairs, often, sums))


def _learn_all(docs: DataFrame, path: str, learner: Learner, classes: np.ndarray) -> None:
    """Go on in each partition with the windows of all its texts; average the weights."""
    shared = docs.sparkSession.sparkContext.broadcast((learner, classes))
    names = [k for k in learner.w if k != "embed"]
    size = len(learner.w["embed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, classes = shared.value
        own, often, n = copy.deepcopy(start), np.zeros(size, np.int64), 0
        for batch in batches:
            windows = cut_windows(*token_ids(path, *words(texts(batch, "text"))))
            own.learn(windows, classes, 1, fall=False)
            often += np.bincount(windows[:, :-1][windows[:, :-1] >= 0], minlength=size)
            n += len(windows)
        if n:
            moved = [np.concatenate([(own.w[k] - start.w[k]).ravel() for k in names])[:, None]]
            weight = [np.full(len(moved[0]), n, np.float64)]
            for k in range(0, size, AVERAGED):
                moved.append((own.w["embed"] - start.w["embed"])[k : k + AVERAGED])
                weight.append(often[k : k + AVERAGED].astype(np.float64))
            for part, (m, c) in enumerate(zip(moved, weight, strict=True)):
                yield record("", part=[part], moved=[(m * c[:, None]).astype("<f8").tobytes()], n=[c.astype("<f8").tobytes()])
        give_back()

    def add(table: pa.Table) -> pa.Table:
        sums = {k: sum(np.frombuffer(x, "<f8") for x in table[k].to_pylist()) for k in ("moved", "n")}
        return pa.table({"part": table["part"].slice(0, 1), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in sums.items()}})

    schema = "part long, moved binary, n binary"
    for r in docs.select("text").mapInArrow(run, schema).groupBy("part").applyInArrow(add, schema).collect():  # a row per AVERAGED ids
        moved, n = np.frombuffer(r.moved, "<f8"), np.frombuffer(r.n, "<f8")
        mean = (moved.reshape(len(n), -1) / np.maximum(n, 1)[:, None]).astype(np.float32)
        if r.part:
            learner.w["embed"][(r.part - 1) * AVERAGED :][: len(mean)] += mean
        else:
            at = 0
            for k in names:
                learner.w[k] += mean[at : at + learner.w[k].size].reshape(learner.w[k].shape)
                at += learner.w[k].size


def count_corpus(docs: DataFrame, path: str) -> DataFrame:
    """(word, pair, c): how often each word, and each pair of neighbouring ids, occurs in all texts; counted in each batch before the shuffle."""
    size = subwords(path).end + 1

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = words(texts(batch, "text"))
            some = Batch(path, *found)
            n = np.bincount(found[0], minlength=len(found[2])).astype(np.int64)
            yield record("", word=found[2].cast(pa.string()), pair=pa.nulls(len(n), pa.int64()), n=n)
            pair, n = some.pair_counts(size)
            yield record("", word=pa.nulls(len(n), pa.string()), pair=pair, n=n)

        return step

    return docs.select("text").mapInArrow(per_batch(make), "word string, pair long, n long").groupBy("word", "pair").agg(F.sum("n").alias("c"))


def _floor(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` rows have it or more."""
    spread = counts.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).count().orderBy(F.col("c").desc()).toPandas()
    few = spread[spread["count"].cumsum() <= most]
    return 1 if len(few) == len(spread) else int(few["c"].min()) if len(few) else 1_000_001


def _totals(pairs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Counts of ids, their classes, and ``class_sums``, over all pairs; every result is of the vocabulary's size."""
    spark = pairs.sparkSession

    def summed(keys: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        def make():
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                key, c = keys(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                return record("", key=key, c=c)

            return step

        got = pairs.select("pair", "c").mapInArrow(per_batch(make), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toArrow()
        out = np.zeros(n)
        out[got["key"].to_numpy()] = got["c"].to_numpy()
        return out

    counts = summed(lambda pair, c: (pair % size, c), size)
    shared = spark.sparkContext.broadcast(counts)
    classes = id_classes(summed(lambda pair, c: context_keys(shared.value, pair, c), 6000 * 514), counts)
    known = spark.sparkContext.broadcast(classes)
    return counts, classes, tuple(summed(lambda pair, c, k=k: (pair_keys(known.value, pair)[k], c), CLASSES * size) for k in range(2))


def _windows(docs: DataFrame, path: str, total: int) -> np.ndarray:
    """Training windows from documents drawn by hash over the whole corpus."""
    rate = min(1.0, FIT_DOCS / max(total, 1))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(rate * 1_000_000) + 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * FIT_DOCS)
    length = 2 * STRIDE + 1

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, ends = token_ids(path, *words(texts(batch, "text")))
            windows = cut_windows(ids, ends).astype("<i4")
            owner = batch.column(0).take(pa.array(np.repeat(np.arange(len(ends) - 1), -(-np.diff(ends) // (length - 1)))))
            return record("", doc_id=owner, w=pa.array([w.tobytes() for w in windows], pa.binary()))

        return step

    made = drawn.select("doc_id", "text").mapInArrow(per_batch(make), "doc_id long, w binary")
    rows = made.orderBy(F.xxhash64("w"), "doc_id", "w").limit(FIT_WINDOWS).toArrow()["w"].to_pylist()
    return np.frombuffer(b"".join(rows), "<i4").reshape(-1, length).astype(np.int64)


def score_documents(docs: DataFrame, learn: Column, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn`` marks training rows by doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = scratch(spark, "lm")
    docs = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    train_docs = docs.filter(learn)
    count_corpus(train_docs, path).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    pairs, counts = counts.filter("pair is not null").select("pair", "c"), counts.filter("pair is null").select("word", "c")
    rows = train_docs.select("doc_id").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total.n + rows, total.v + (rows > 0)  # with the end token
    size = subwords(path).end + 1
    pair_floor = _floor(pairs, BROADCAST_PAIRS)
    often = pairs.filter(F.col("c") >= pair_floor).toArrow().sort_by("pair")
    windows, all_pairs = _windows(train_docs, path, rows), pair_floor == 1
    every = None if all_pairs else _totals(pairs, size)
    model = train(windows, often["pair"].to_numpy(), often["c"].to_numpy(), size, every=every, more=lambda learner, classes: _learn_all(train_docs, path, learner, classes))
    floor = _floor(counts, BROADCAST_WORDS)

    def hashed():
        return lambda batch: record("", h=word_hashes(batch.column(0)).view(np.int64), c=batch.column(1))

    frequent = counts.filter(F.col("c") >= floor).select("word", "c").mapInArrow(per_batch(hashed), "h long, c long").toArrow()
    keys = frequent["h"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((model, keys[order], frequent["c"].to_numpy()[order]))
    whole = floor == 1
    end_count, norm = rows, np.log10(n + v + 1)

    def make():
        model, keys, found = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            codes, offsets, dictionary = words(texts(batch, "text"))
            h = word_hashes(dictionary)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            c = np.where(keys[at] == h, found[at], 0) if len(keys) else np.zeros(len(h), np.int64)
            word_score = np.log10(c + 1.0) - norm
            rare = (c == 0) & (not whole)
            count = np.diff(offsets) + 1
            left = rare[codes]
            known = segment_sum((c[codes] > 0).astype(np.int64), offsets) + (end_count > 0)
            base = segment_sum(word_score[codes], offsets) + np.log10(end_count + 1.0) - norm
            row, word = row_of(offsets)[left], codes[left]
            lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32), dictionary.take(pa.array(word)).cast(pa.string()))
            score, owner, pair, coarse = model.score_known(Batch(path, codes, offsets, dictionary))
            ends = np.searchsorted(owner, np.arange(len(offsets)) if not all_pairs else np.zeros(len(offsets))).astype(np.int32)
            far, share = (pa.ListArray.from_arrays(ends, pa.array(x[: ends[-1]])) for x in (pair, coarse))
            return record("", doc_id=batch.column(0), n_tokens=count.astype(np.int64), n_known=known.astype(np.int64), base_score=base, score=score, rare=lists, pairs=far, coarse=share)

        return step

    scored = docs.mapInArrow(per_batch(make), "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<string>, pairs array<long>, coarse array<float>")
    kept = F.lit(int(n)).cast("long").alias("train_tokens")
    if whole and all_pairs:
        return scored.select("doc_id", "n_tokens", "n_known", kept, "base_score", "score")
    scored.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/scored")
    scored = spark.read.parquet(f"{folder}/scored")
    none = F.lit(0.0)
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts.filter(F.col("c") < floor), "word").select("row", F.lit(1).alias("more"), F.log10(F.col("c") + 1.0).alias("base"), none.alias("own"))
    if not all_pairs:
        far = scored.select("row", F.explode(F.arrays_zip("pairs", "coarse")).alias("p")).select("row", "p.pairs", "p.coarse")
        far = far.join(pairs.filter(F.col("c") < pair_floor).withColumnRenamed("pair", "pairs"), "pairs")
        far = far.select("row", F.lit(0).alias("more"), none.alias("base"), (F.log1p(F.col("c") / BY_ID * F.exp(-F.col("coarse").cast("double"))) / F.lit(float(np.log(10)))).alias("own"))
        rare = far if whole else rare.union(far)
    more = rare.groupBy("row").agg(F.sum("more").alias("more"), F.sum("base").alias("base"), F.sum("own").alias("own"))
    out = scored.drop("rare", "pairs", "coarse").join(more, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), kept, *((F.col(a) + F.coalesce(b, none)).alias(a) for a, b in (("base_score", "base"), ("score", "own"))))
