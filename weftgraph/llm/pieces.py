"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The public model is of the merge kind: adjacent pieces merge, best score
first.  A sequence of pieces is the result of that process exactly if each two
neighbours are compatible: merging their characters alone doesn't cross the
border between them (pieces that the process can't make are left out).  So
encoding is a shortest-path problem: states are pieces ending at a place, a
step between compatible pieces weighs 0 and any other minus infinity, and the
one path of weight 0 is the encoding.

A text is cut into chunks.  At a cut the states are the pieces that cover the
character before it, with their overhang; a chunk gives the max-plus matrix
from the states at its start to those at its end.  Matrices are multiplied in a
tree, as the product is associative; going down the tree, the states at the ends
of a product fix the one between its factors; then each chunk is backtraced on
its own.  Blanks that follow a non-blank always begin a piece, so
a cut there has a single state; cuts are placed there if one is near.  Inside a
chunk each distinct word is solved once, all words of a batch in lockstep.
Runs of blanks have equal merge scores and are merged from the left.

Texts of up to ``GIANT`` characters are solved within a batch.  Longer ones
are dealt out by chunk: matrices, the levels of the tree and backtrace are
separate Spark stages.

Defined cases: a null or empty text has no pieces; repeated rows are encoded
alike; U+2581 reads as a blank, as in the model's own normalisation; characters
that aren't pieces become byte pieces; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches, map_rows, only, per_batch, record, shared_dir, texts

BLANK = "▁"
#: Words up to this length are solved in lockstep; longer ones one at a time.
LOCKSTEP = 40
#: Characters of a chunk, how far a cut is moved back to reach a blank, and the
#: length from which on a text's chunks are dealt to different tasks.
CHUNK, REACH, GIANT = 16_384, 2_048, 60_000
#: Neighbouring matrices of a text that are multiplied in one task.
FAN = 256
#: Words that a worker keeps with their pieces.
CACHED_WORDS = 250_000
NEVER = np.int64(1) << 40


class Table:
    """A vectorised hash table from non-negative 64-bit keys to 32-bit values."""

    def __init__(self, items: dict[int, int] | tuple[np.ndarray, np.ndarray]):
        given = items if isinstance(items, tuple) else (list(items), list(items.values()))
        left, value = np.array(given[0], np.int64), np.array(given[1], np.int32)
        self.bits = max(4, (3 * len(left)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        place, self.probes = self._hash(left), 0
        while len(left):
            self.probes += 1
            free = self.keys[place] < 0
            self.keys[place[free]] = left[free]
            won = free & (self.keys[place] == left)
            self.values[place[won]] = value[won]
            left, value, place = left[~won], value[~won], (place[~won] + 1) & (size - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = self._hash(keys)
        at = self.keys[place]
        out = np.where(at == keys, self.values[place], np.int32(-1))
        open_ = np.flatnonzero((at != keys) & (at >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & (len(self.keys) - 1)
            at = self.keys[place[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[place[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
        return out


@dataclass(frozen=True)
class State:
    """A piece that covers the character before a cut and ends ``over`` characters after it; -1 stands for a border."""

    piece: int
    over: int


class PieceModel:
    """Pieces, merge ranks and the compatibility of neighbours."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.size = n
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain if names[i].strip(BLANK) or names[i] == BLANK}
        runs = {len(names[i]): i for i in plain if not names[i].strip(BLANK)}
        if any(BLANK in p[1:] for p in self.ids):
            raise ValueError("a piece has an inner blank: words can't be solved apart")
        self.runs, self.names = runs, names
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = [names[i].replace(BLANK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i):
                self.text[i] = b""
        order = sorted(self.ids.values(), key=lambda i: -model.get_score(i))
        self.rank = np.full(n + 1, -1, np.int64)
        merged = [i for i in order if len(names[i]) > 1]
        self.rank[merged] = np.arange(len(merged))
        ranks = self.rank.tolist()
        self.left, self.right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        for i in merged:
            parts = self._merge([self.ids.get(c, n) for c in names[i]], ranks, stop=2)
            if len(parts) == 2 and self.ids.get(self._name(parts[0]) + self._name(parts[1])) == i:
                self.left[i], self.right[i] = parts
        made = {names[i] for i in self.ids.values() if len(names[i]) == 1 or self.left[i] >= 0}
        self.longest = max(map(len, made))
        pairs = {self.ids[p[:k]] * (n + 1) + self.ids[p[k:]]: ranks[self.ids[p]] for p in self.ids if len(p) > 1 for k in range(1, len(p)) if p[:k] in made and p[k:] in made}
        self.pairs = Table(pairs)
        self.symbol = {c: k for k, c in enumerate(sorted({c for p in made for c in p}))}
        self.unknown = len(self.symbol)
        points = np.full(0x110000, self.unknown, np.int32)
        points[[ord(c) for c in self.symbol]] = list(self.symbol.values())
        self.points, wide = points, self.unknown + 1
        nodes, moves, piece = {"": 0}, {}, [-1]
        for p in sorted(made, key=len):
            node = 0
            for k, c in enumerate(p):
                key = node * wide + self.symbol[c]
                if key not in moves:
                    moves[key] = len(piece)
                    piece.append(-1)
                node = moves[key]
            piece[node] = self.ids[p]
        self.moves, self.moves_of, self.piece = Table(moves), moves, np.array(piece, np.int32)
        self.char = np.full(wide, n, np.int32)
        for c, k in self.symbol.items():
            self.char[k] = self.ids.get(c, n)
        self.known: dict[tuple[int, int], bool] = {}

    def _name(self, piece: int) -> str:
        return self.names[piece] if piece < self.size else "\0"

    def _merge(self, parts: list[int], ranks: list[int], stop: int = 1) -> list[int]:
        """Merge the best adjacent pair, leftmost first, until none is left or ``stop`` parts are."""
        while len(parts) > stop:
            best = min(((ranks[m], k, m) for k in range(len(parts) - 1) if (m := self.ids.get(self._name(parts[k]) + self._name(parts[k + 1]), -1)) >= 0), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [best[2]]
        return parts

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each piece a may stand before b: undo the later of both merges, again and
        again; at no time may the two pieces at the border have merged before being used up."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), NEVER)
        while len(live):
            found = self.pairs(a * (self.size + 1) + b)
            crossed = (found >= 0) & (found < limit)
            good[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            live, a, b, limit, ra, rb = live[go], a[go], b[go], limit[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a).astype(np.int64), np.where(first, b, self.left[b]).astype(np.int64)
        return good

    def allowed(self, a: int, b: int) -> bool:
        if a < 0 or a == self.size or b == self.size:
            return True
        got = self.known.get((a, b))
        if got is None:
            got = bool(self.compatible(np.array([a]), np.array([b]))[0])
            if len(self.known) < 1_000_000:
                self.known[a, b] = got
        return got

    def solve(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of equally long words at once: symbols (words, n) to (last piece, start) of each prefix."""
        count, n = text.shape
        last = np.full((count, n + 1), -1, np.int32)
        start = np.zeros((count, n + 1), np.int32)
        wide = self.unknown + 1
        for i in range(n):
            row, node = np.arange(count), np.zeros(count, np.int64)
            for j in range(i + 1, n + 1):
                c = text[row, j - 1]
                if j == i + 1:
                    piece = self.char[c]
                    node = self.moves(node * wide + c)
                else:
                    node = self.moves(node.astype(np.int64) * wide + c)
                    row, node = row[node >= 0], node[node >= 0]
                    if not len(row):
                        break
                    piece = self.piece[node]
                here = np.flatnonzero((piece >= 0) & (last[row, j] < 0))
                if i:
                    before = last[row[here], i]
                    both = (before < self.size) & (piece[here] < self.size)
                    fine = ~both
                    fine[both] = self.compatible(before[both], piece[here][both])
                    here = here[fine]
                last[row[here], j] = piece[here]
                start[row[here], j] = i
                if j == i + 1:
                    row, node = row[node >= 0], node[node >= 0]
        return last, start

    def trace(self, last: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all words in order, count of each word)."""
        count, n = len(last), last.shape[1] - 1
        out = np.full((count, n), -1, np.int32)
        at, row = np.full(count, n), np.arange(count)
        while len(row):
            s = start[row, at[row]]
            out[row, s] = last[row, at[row]]
            at[row] = s
            row = row[s > 0]
        return out[out >= 0], (out >= 0).sum(1)

    def walk(self, text: str, begin: int, piece: int, cut: int) -> dict[int, tuple[int, int]]:
        """From ``piece`` ending at ``begin``: the one last piece (and its start) at each later
        place that a path reaches; pieces begin before ``cut`` but may reach beyond it."""
        found = {begin: (piece, -1)}
        wide, n = self.unknown + 1, self.size
        ends = {}
        for i in range(begin, cut):
            if i not in found:
                continue
            before, node = found[i][0], 0
            for j in range(i + 1, len(text) + 1):
                k = int(self.points[ord(text[j - 1])])
                node = self.moves_of.get(node * wide + k, -1)
                p = int(self.piece[node]) if node >= 0 else -1
                if j == i + 1 and p < 0:
                    p = int(self.char[k])
                if p >= 0 and self.allowed(before, p):
                    if j <= cut or p != n:
                        if j < cut:
                            found.setdefault(j, (p, i))
                        else:
                            ends[p, j] = i
                if node < 0:
                    break
        self.ends = ends
        return found

    def word_ids(self, word: str) -> list[int]:
        """Pieces of one long word without inner blanks; unknown characters stand as ``size``."""
        found = self.walk(word, 0, -1, len(word))
        j, out = len(word), []
        piece, i = next((p, i) for (p, e), i in self.ends.items() if e == j)
        while True:
            out.append(piece)
            if i == 0:
                return out[::-1]
            piece, i = found[i]

    def run(self, n: int) -> list[int]:
        """Pieces of n blanks: equal scores, so the leftmost pair merges first."""
        out: list[int] = []
        top = max(self.runs)
        while n >= 2 * top:  # the first run is full before the next begins
            out.append(self.runs[top])
            n -= top
        parts = [1] * n
        while True:
            k = next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.runs), None)
            if k is None:
                return out + [self.runs[p] for p in parts]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]


def _dump(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class Encoder:
    """Encodes batches of texts; keeps the words it has seen first."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.kept: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        """Pieces of BLANK + word for each word as bytes of 32-bit ids, byte pieces for unknown characters."""
        new = [w for w in words if w not in self.kept]
        got: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w) + 1, []).append(w)
        m = self.model
        for n, same in by_length.items():
            if n > LOCKSTEP:
                for w in same:
                    got[w] = _dump(self._bytes(BLANK + w, m.word_ids(BLANK + w)))
                continue
            joined = np.frombuffer("".join(BLANK + w for w in same).encode("utf-32-le"), np.uint32)
            symbols = m.points[joined].reshape(-1, n)
            flat, count = m.trace(*m.solve(symbols))
            ends = np.cumsum(count)
            strange = np.add.reduceat(flat == m.size, ends - count) if len(flat) else count
            data = flat.astype("<i4").tobytes()
            got.update((w, data[4 * a : 4 * b]) for w, a, b in zip(same, (ends - count).tolist(), ends.tolist(), strict=True))
            for k in np.flatnonzero(strange).tolist():
                got[same[k]] = _dump(self._bytes(BLANK + same[k], flat[ends[k] - count[k] : ends[k]].tolist()))
        out = [got[w] if w in got else self.kept[w] for w in words]
        if len(self.kept) < CACHED_WORDS:
            self.kept.update(got)
        return out

    def _bytes(self, text: str, ids: list[int]) -> list[int]:
        m, out, at = self.model, [], 0
        for i in ids:
            if i == m.size:
                out += [m.byte[b] for b in text[at].encode()]
                at += 1
            else:
                out.append(i)
                at += len(m.names[i])
        return out

    def batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets)."""
        text = pc.replace_substring(text, BLANK, " ")
        split = pc.split_pattern(text, " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        flat = split.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
        ends = ends - ends[0]
        n_chars = pc.utf8_length(text).to_numpy()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        lists = self.words(coded.dictionary.to_pylist())
        blank = self.model.ids[BLANK]
        empty = (pc.binary_length(flat).to_numpy() == 0)
        if empty.any():
            codes, lists = self._runs(codes, ends, empty, n_chars, lists, blank)
        size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        pool = np.frombuffer(b"".join(lists), "<i4")
        first = np.concatenate([[0], np.cumsum(size)])
        per = size[codes]
        total = np.concatenate([[0], np.cumsum(per)])
        out = pool[np.repeat(first[codes] - total[:-1], per) + np.arange(total[-1])]
        return out, total[ends]

    def _runs(self, codes, ends, empty, n_chars, lists, blank):
        """Words after several blanks get entries of their own; blanks before them get none."""
        codes, lists = codes.copy(), list(lists)
        own: dict[tuple[int, int], int] = {}
        nothing = len(lists)
        lists.append(b"")
        last_of = np.zeros(len(codes), bool)
        full = np.diff(ends) > 0
        last_of[ends[1:][full] - 1] = True
        first_of = np.zeros(len(codes), bool)
        first_of[ends[:-1][full]] = True
        for row in np.flatnonzero(full & (n_chars == 0)):
            codes[ends[row]] = nothing
            empty[ends[row]] = False
        run, word = 0, -1
        index = np.flatnonzero(empty)
        cuts = np.flatnonzero((np.diff(index) > 1) | first_of[index[1:]]) + 1 if len(index) else []
        for part in np.split(index, cuts):
            if not len(part):
                continue
            k, end = len(part), int(part[-1])
            codes[part] = nothing
            if last_of[end]:
                run, word, at = k, -1, end
            else:
                run, word, at = k + 1, int(codes[end + 1]), end + 1
            if (run, word) not in own:
                ids = np.frombuffer(lists[word], "<i4").tolist() if word >= 0 else []
                lone = bool(ids) and ids[0] == blank
                own[run, word] = len(lists)
                lists.append(_dump(self.model.run(run if lone or word < 0 else run - 1) + (ids[1:] if lone else ids)))
            codes[at] = own[run, word]
        return codes, lists

    def text(self, text: str) -> list[int]:
        return self.batch(pa.array([text], pa.large_string()))[0].tolist()


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode(model: PieceModel, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of rows of ids: bytes of the pieces, without the blank put before each text."""
    pool = np.frombuffer(b"".join(model.text), np.uint8)
    size = np.fromiter(map(len, model.text), np.int64, len(model.text))
    first = np.cumsum(size) - size
    per = size[ids]
    total = np.concatenate([[0], np.cumsum(per)])
    data = pool[np.repeat(first[ids] - total[:-1], per) + np.arange(total[-1])]
    ends = total[offsets]
    keep = np.ones(len(data), bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False
    bounds = np.concatenate([[0], np.cumsum(np.diff(ends) - (np.diff(ends) > 0))])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(bounds.astype("<i8").tobytes()), pa.py_buffer(data[keep].tobytes())])


# The chunk scan -------------------------------------------------------------


def cut_places(text: str, chunk: int = CHUNK, reach: int = REACH) -> list[int]:
    """Places that part a text (with blanks marked) into chunks: at a blank after a non-blank if one is near, never inside a run of blanks."""
    cuts, at = [0], 0
    while len(text) - at > chunk:
        p = at + chunk
        near = next((q for q in range(p, max(at, p - reach), -1) if text[q] == BLANK != text[q - 1]), None)
        if near is None:
            while p < len(text) and text[p] == BLANK == text[p - 1]:
                p += 1
            near = p
        if near >= len(text):
            break
        cuts.append(near)
        at = near
    return [*cuts, len(text)]


def forced(text: str, p: int) -> bool:
    """Whether a piece must begin at p."""
    return p <= 0 or p >= len(text) or (text[p] == BLANK and text[p - 1] != BLANK)


def states_at(model: PieceModel, text: str, p: int) -> list[State]:
    """The states at a cut: pieces that cover the character before it."""
    if forced(text, p):
        return [State(-1, 0)]
    out = []
    for i in range(max(0, p - model.longest), p):
        for j in range(p, min(len(text), i + model.longest) + 1):
            piece = model.ids.get(text[i:j], -1)
            if piece >= 0 and (len(text[i:j]) == 1 or model.left[piece] >= 0):
                out.append(State(piece, j - p))
    if text[p - 1] not in model.ids:
        out.append(State(model.size, 0))
    return out


def word_spans(text: str, p: int, q: int) -> tuple[int, int]:
    """The first and last forced border in [p, q], or (-1, -1)."""
    a = next((i for i in range(p, q + 1) if forced(text, i)), -1)
    return (a, next(i for i in range(q, p - 1, -1) if forced(text, i))) if a >= 0 else (-1, -1)


def _paths(enc: Encoder, text: str, p: int, q: int, state: State, inner: dict[tuple[int, int], list[int]] | None = None) -> dict[State, list[int]]:
    """From one state at p: the pieces that begin in this chunk, for each state at q that is reached.

    ``inner`` keeps what lies between the first and last forced borders, which the chunk's states share.
    """
    model = enc.model
    begin = p + state.over
    if begin > q:  # the piece covers the whole chunk
        return {State(state.piece, begin - q): []}
    a, b = word_spans(text, begin, q)

    def steps(begin: int, piece: int, end: int) -> dict[State, list[int]]:
        """Paths over a stretch without forced borders inside; blanks at its start form a run."""
        border = forced(text, end)
        if begin == end:
            return {State(-1 if border else piece, 0): []}
        run = 0
        while piece < 0 and begin + run < end and text[begin + run] == BLANK:
            run += 1
        if run == end - begin and border:
            return {State(-1, 0): model.run(run)}
        begin += max(0, run - 1)
        found = model.walk(text, begin, piece, end)
        out = {}
        for (last, j), i in model.ends.items():
            if j > end and border:
                continue
            ids, k = [last], i
            while k > begin:
                last_k, k2 = found[k]
                ids.append(last_k)
                k = k2
            ids = enc._bytes(text[begin : end + model.longest], ids[::-1])
            if run:
                lone = ids[0] == model.ids[BLANK]
                ids = model.run(run if lone else run - 1) + ids[lone:]
            out[State(-1, 0) if border else State(last, j - end)] = ids
        return out

    if a < 0:
        return steps(begin, state.piece, q)
    head = steps(begin, state.piece, a).get(State(-1, 0)) if a > begin or not forced(text, begin) else []
    if head is None:
        return {}
    inner = {} if inner is None else inner
    if (a, b) not in inner:
        inner[a, b] = [] if b == a else enc.text(text[a + 1 : b]) or model.run(1)
    middle = inner[a, b]
    tail = steps(b, -1, q) if q > b else {State(-1, 0): []}
    return {s: head + middle + ids for s, ids in tail.items()}


def transfer(enc: Encoder, text: str, p: int, q: int) -> tuple[list[State], list[State], np.ndarray]:
    """(states at p, states at q, max-plus matrix): 0 where a path leads from one to the other, else -inf."""
    into, out = states_at(enc.model, text, p), states_at(enc.model, text, q)
    at = {s: k for k, s in enumerate(out)}
    matrix = np.full((len(into), len(out)), -np.inf, np.float32)
    inner: dict[tuple[int, int], list[int]] = {}
    for k, s in enumerate(into):
        for reached in _paths(enc, text, p, q, s, inner):
            if reached in at:
                matrix[k, at[reached]] = 0
    return into, out, matrix


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def _levels(matrices: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The tree of products: each level holds those of neighbours on the level before; an odd last one moves up."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([max_plus(*below[k : k + 2]) if k + 1 < len(below) else below[k] for k in range(0, len(below), 2)])
    return levels


def product(matrices: list[np.ndarray]) -> np.ndarray:
    return _levels(matrices)[-1][0]


def between(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The state at each cut on the best path between two states, down the tree of products."""
    states = [enter, leave]
    for below in _levels(matrices)[-2::-1]:
        out = [enter]
        for k, end in enumerate(states[1:]):
            if 2 * k + 1 < len(below):
                out.append(int((below[2 * k][out[-1]] + below[2 * k + 1][:, end]).argmax()))
            out.append(end)
        states = out
    return states


def scan(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut on the best path: products up a tree, then states down it, each from its ends alone."""
    whole = product(matrices)
    return between(matrices, *(int(x) for x in np.unravel_index(whole.argmax(), whole.shape)))


def backtrace(enc: Encoder, text: str, p: int, q: int, enter: State, leave: State) -> list[int]:
    """The pieces that begin in [p, q) on the path between two states."""
    return _paths(enc, text, p, q, enter)[leave]


def encode_scanned(enc: Encoder, text: str, chunk: int = CHUNK, reach: int = REACH) -> list[int]:
    """Encode one text by the chunk scan, in one process."""
    if not text:
        return []
    marked = BLANK + text.replace(" ", BLANK)
    cuts = cut_places(marked, chunk, reach)
    parts = [transfer(enc, marked, p, q) for p, q in zip(cuts, cuts[1:], strict=False)]
    states = scan([m for _, _, m in parts])
    out: list[int] = []
    for (p, q), (into, to, _), a, b in zip(zip(cuts, cuts[1:], strict=False), parts, states, states[1:], strict=False):
        out += backtrace(enc, marked, p, q, into[a], to[b])
    return out


# Over a table ----------------------------------------------------------------


def _deal_chunks(giants: DataFrame, chunk: int, reach: int) -> DataFrame:
    """(key, k, last, p, q, text): each chunk of each giant text, with what lies around it as far as a piece reaches."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for key, text in zip(batch.column(0).to_pylist(), texts(batch, "text").to_pylist(), strict=True):
                marked = BLANK + text.replace(" ", BLANK)
                cuts = cut_places(marked, chunk, reach)
                for k, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    a, b = max(0, p - 64), min(len(marked), q + 64)
                    rows = record("", key=[key], k=[k], p=[p - a], q=[q - a], text=[marked[a:b]], more=[q < len(marked)])
                    yield rows.cast(pa.schema([("key", pa.binary()), ("k", pa.int32()), ("p", pa.int32()), ("q", pa.int32()), ("text", pa.string()), ("more", pa.bool_())]))

        return step

    return giants.mapInArrow(per_batch(make), "key binary, k int, p int, q int, text string, more boolean")


MATRIX = "key binary, k int, n int, matrix binary"


def _matrices(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.where(np.frombuffer(m, np.uint8).reshape(n, -1) > 0, 0, -np.inf).astype(np.float32) for m, n in zip(frame["matrix"], frame["n"], strict=True)]


def _fold(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The product of up to FAN neighbouring matrices of one text."""
    whole = product(_matrices(frame.sort_values("k")))
    return pd.DataFrame({"key": [keys[0]], "k": [keys[1]], "n": [len(whole)], "matrix": [(whole == 0).astype(np.uint8).tobytes()]})


def _part(keys: tuple, frame: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """The states at both ends of each of some neighbouring matrices; ``ends`` has those of their product, or is empty at the top."""
    frame = frame.sort_values("k")
    matrices = _matrices(frame)
    states = between(matrices, int(ends["enter"].iloc[0]), int(ends["leave"].iloc[0])) if len(ends) else scan(matrices)
    return pd.DataFrame({"key": [keys[0]] * len(frame), "k": frame["k"], "enter": states[:-1], "leave": states[1:]})


def encode_giants(giants: DataFrame, path: str, chunk: int = CHUNK, reach: int = REACH, fan: int = FAN) -> DataFrame:
    """(key, k, ids): the pieces of each chunk of (key binary, text).

    Matrices of chunks are multiplied ``fan`` neighbours at a time, level by
    level, until a text has ``fan`` at most; states come down the same levels.
    So no task holds more than ``fan`` matrices of a text, however long it is.
    """
    spark = giants.sparkSession
    shared_dir(spark)
    sizes = giants.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.max(F.length("text")), F.lit(0))).first()
    # asked for by number, so that few bytes of much work aren't put together
    tasks = int(max(1, min(sizes[0] // chunk + 1, max(4 * spark.sparkContext.defaultParallelism, sizes[0] // (64 * chunk)))))
    each = giants.dropDuplicates(["key"]).repartition(tasks, "key")
    chunks = _deal_chunks(each, chunk, reach).repartition(tasks, F.col("key"), F.col("k")).checkpoint()

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for f in frames:
            made = [transfer(enc, t, p, q)[2] for t, p, q in zip(f["text"], f["p"], f["q"], strict=True)]
            yield pd.DataFrame({"key": f["key"], "k": f["k"], "n": [len(m) for m in made], "matrix": [(m == 0).astype(np.uint8).tobytes() for m in made]})

    levels, most = [chunks.mapInPandas(matrices, MATRIX).checkpoint()], (chunks.agg(F.max("k")).first()[0] or 0) + 1
    group = F.floor(F.col("k") / fan).cast("int").alias("g")
    while most > fan:
        levels.append(levels[-1].groupBy("key", group).applyInPandas(_fold, MATRIX).checkpoint())
        most = -(-most // fan)
    states = spark.createDataFrame([], "key binary, k int, enter int, leave int")
    for level in reversed(levels):
        above = states.select(F.col("key").alias("of"), F.col("k").alias("g"), "enter", "leave")
        states = level.groupBy("key", group).cogroup(above.groupBy("of", "g")).applyInPandas(_part, "key binary, k int, enter int, leave int")

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for f in frames:
            out = []
            for t, p, q, a, b in zip(f["text"], f["p"], f["q"], f["enter"], f["leave"], strict=True):
                ends = states_at(enc.model, t, p)[a], states_at(enc.model, t, q)[b]
                out.append(np.array(backtrace(enc, t, p, q, *ends), "<u4").tobytes())
            yield pd.DataFrame({"key": f["key"], "k": f["k"], "ids": out})

    return chunks.join(states, ["key", "k"]).repartition(tasks, "key", "k").mapInPandas(traced, "key binary, k int, ids binary")


def _bytes_of(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype("<i8").tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())


def encode_documents(docs: DataFrame, path: str, giant: int = GIANT) -> DataFrame:
    """All columns of ``docs`` with ``pieces``, the little-endian 32-bit ids of the text (a column of that name is replaced)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("pieces")
    schema = docs.withColumn("pieces", F.lit(b"")).schema

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, offsets = encoder(path).batch(texts(batch, "text"))
            return pa.RecordBatch.from_arrays([*batch.columns, _bytes_of(ids, offsets)], [*batch.schema.names, "pieces"])

        return step

    big = F.coalesce(F.length("text"), F.lit(0)) > giant
    short = map_rows(docs.filter(~big), make, schema)
    if docs.filter(big).isEmpty():
        return short
    key = F.unhex(F.sha2("text", 256))
    giants = encode_giants(docs.filter(big).select(key.alias("key"), "text"), path)
    joined = giants.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    own = next(n for n in (f"key{k}" for k in range(len(docs.columns) + 1)) if n not in {c.lower() for c in docs.columns})
    whole = joined.select(F.col("key").alias(own), F.aggregate(F.transform("parts", lambda x: F.hex(x.ids)), F.lit(""), lambda a, x: F.concat(a, x), F.unhex).alias("pieces"))
    return short.union(docs.filter(big).join(whole, key == F.col(own)).drop(own))


def decode_documents(encoded: DataFrame, path: str, pieces: str = "pieces") -> DataFrame:
    """All columns with ``decoded``, the text of the ids."""
    bounded_batches(encoded.sparkSession)
    schema = encoded.withColumn("decoded", F.lit("")).schema

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = decode(encoder(path).model, *_ids_of(batch, pieces))
            return pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.string())], [*batch.schema.names, "decoded"])

        return step

    return map_rows(encoded, make, schema)


def _ids_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    blob = batch.column(batch.schema.get_field_index(name)).fill_null(b"").cast(pa.large_binary())
    ends = np.frombuffer(blob.buffers()[1], "<i8", len(blob) + 1 + blob.offset)[blob.offset :]
    data = np.frombuffer(blob.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u4")
    return data.astype(np.int64), (ends - ends[0]) // 4


DIGESTS = "doc_id long, n_chars long, n_pieces long, pieces_crc32 long, round_trip boolean"


def _digests(model: PieceModel, doc_id: pa.Array, text: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    data = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    same = pc.equal(decode(model, ids, ends), pc.replace_substring(text, BLANK, " "))
    return record("", doc_id=doc_id, n_chars=pc.utf8_length(text).cast(pa.int64()), n_pieces=np.diff(ends), pieces_crc32=np.array(crc, np.int64), round_trip=same)


def piece_digests(docs: DataFrame, path: str, giant: int = GIANT) -> DataFrame:
    """(doc_id, n_chars, n_pieces, pieces_crc32, round_trip): ids counted and digested; whether they decode to the text."""
    bounded_batches(docs.sparkSession)
    docs = only(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    big = F.coalesce(F.length("text"), F.lit(0)) > giant

    def both():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            text, enc = texts(batch, "text"), encoder(path)
            return _digests(enc.model, batch.column(0), text, *enc.batch(text))

        return step

    def read():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return _digests(encoder(path).model, batch.column(0), texts(batch, "text"), *_ids_of(batch, "pieces"))

        return step

    short = docs.filter(~big).mapInArrow(per_batch(both), DIGESTS)
    return short.union(encode_documents(docs.filter(big), path, giant).select("doc_id", "text", "pieces").mapInArrow(per_batch(read), DIGESTS))
