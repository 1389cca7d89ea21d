"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built; it accepts
exactly the substrings of that text.  A text is parsed greedily into longest
matches against each automaton; related languages need few, long phrases.  The
language with the fewest phrases, normalised by what its own text needs, wins.

Texts are folded first: letters lowered, and every run of other characters one
blank.  They are parsed in blocks of ``BLOCK`` folded characters, all blocks of
a batch in lockstep over the automaton's transition table; a phrase ends at its
block's end, so each block adds at most one phrase for every language alike.

Defined cases: a null text, or one without letters, is ``und`` with score 0.
Repeated rows are labelled alike; ties go to the language first in sorted
order; an empty table gives no rows; if no language could be learned, every
text is ``und``.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches, only, per_batch, record, segment_sum, texts

#: Folded characters of labelled text that an automaton is built from, rows
#: that they come from, and characters taken from each row, at most, per language.
FIT_CHARS, FIT_ROWS, FIT_ROW_CHARS = 30_000, 60, 600
BLOCK = 1024
#: Columns of a transition table: the most frequent symbols have one each, the last is for all others,
#: whose transitions are looked up by (state, symbol).
SYMBOLS = 160


@cache
def _lowered() -> np.ndarray:
    """For each code point: its lower-case form, or a blank where it isn't a letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            out[point] = ord(low[0]) if low else point
    return out


def fold(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all rows, and offsets; each row that has letters starts and ends with a blank."""
    joined = text.to_pylist()
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low = _lowered()[points]
    blank = low == 32
    first = np.zeros(len(low) + 1, bool)
    first[ends[:-1]] = True
    keep = ~blank
    keep[1:] |= ~blank[:-1] & ~first[1:-1]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return np.where(blank, np.uint32(32), low)[keep], kept[ends]


class SuffixAutomaton:
    """The smallest automaton of all substrings of a string, built online."""

    def __init__(self, text: str):
        self.step: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.step)
            self.step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.step[p]:
                self.step[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.step)
                    self.step.append(dict(self.step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.step[p].get(c) == q:
                        self.step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


@dataclass
class CrossParser:
    """Transition tables: a negative entry is ~s where a new phrase starts in state s."""

    languages: list[str]
    symbols: np.ndarray
    tables: list[np.ndarray]
    norms: np.ndarray
    #: Per language, ascending state * len(letters) + symbol and the state that follows, for symbols without a column.
    sparse: list[tuple[np.ndarray, np.ndarray]]
    #: Per language, the start of a new phrase with each symbol.
    roots: list[np.ndarray]

    def phrases(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row against each language, as rows by languages."""
        count = -(-np.diff(offsets) // BLOCK)
        ends = np.concatenate([[0], np.cumsum(count)])
        start = np.repeat(offsets[:-1], count) + BLOCK * (np.arange(ends[-1]) - np.repeat(ends[:-1], count))
        size = np.minimum(BLOCK, np.repeat(offsets[1:], count) - start)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        column = self.symbols[points]
        state = [np.zeros(len(size), np.int32) for _ in self.tables]
        made = [np.zeros(len(size), np.int32) for _ in self.tables]
        wide = np.int32(SYMBOLS)
        for t, n in enumerate(live):
            c = column[start[:n] + t]
            rare = np.flatnonzero(c >= wide - 1)
            few = c[rare]
            c = np.minimum(c, wide - 1)
            for k, table in enumerate(self.tables):
                to = table[state[k][:n] * wide + c]
                if len(rare):
                    keys, after = self.sparse[k]
                    key = state[k][rare].astype(np.int64) * len(self.roots[k]) + few
                    at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                    to[rare] = np.where(keys[at] == key, after[at], self.roots[k][few]) if len(keys) else self.roots[k][few]
                sign = to >> 31
                made[k][:n] -= sign
                state[k][:n] = to ^ sign
        out = np.zeros((len(offsets) - 1, len(self.tables)), np.int64)
        for k, m in enumerate(made):
            back = np.empty(len(m), np.int64)
            back[order] = m + 1
            out[:, k] = segment_sum(back, ends)
        return out

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        points, offsets = fold(text)
        n = np.diff(offsets)
        if not self.languages:
            return ["und"] * len(n), np.zeros(len(n))
        rate = self.phrases(points, offsets) / np.maximum(n, 1)[:, None] / self.norms
        best = rate.argmin(1)
        share = np.exp(-8 * (rate / np.maximum(rate.min(1, keepdims=True), 1e-12) - 1))
        score = np.where(n > 0, 1 / share.sum(1), 0.0)
        return [self.languages[b] if m else "und" for b, m in zip(best, n, strict=True)], score


def build_parser(samples: dict[str, list[str]], limit: int = FIT_CHARS) -> CrossParser:
    """Automata over the even sample rows of each language; norms from parsing the odd ones.

    A norm is the phrases per character that a language's automaton needs for
    its own language, so unequal amounts of labelled text don't decide.
    """
    folded = {}
    for lang in sorted(samples):
        points, offsets = fold(pa.array(samples[lang], pa.large_string()))
        rows = ["".join(map(chr, points[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b > a]
        if rows:
            folded[lang] = rows
    letters, seen = np.unique(np.array([ord(c) for rows in folded.values() for r in rows for c in r], np.uint32), return_counts=True)
    letters = letters[np.argsort(-seen, kind="stable")]
    # the last symbol is any character that no sample has
    many = max(len(letters), SYMBOLS - 1) + 1
    symbols = np.full(sys.maxunicode + 1, many - 1, np.int32)
    symbols[letters] = np.arange(len(letters))
    tables, sparse, roots = [], [], []
    for rows in folded.values():
        text = "".join(rows[::2])[:limit]
        automaton = SuffixAutomaton(text)
        table = np.zeros((len(automaton.step), SYMBOLS), np.int32)
        root = np.zeros(many, np.int32)
        for c, s in automaton.step[0].items():
            root[symbols[ord(c)]] = s
        table[:] = ~root[:SYMBOLS]
        far = {}
        for state, moves in enumerate(automaton.step):
            for c, s in moves.items():
                if symbols[ord(c)] < SYMBOLS - 1:
                    table[state, symbols[ord(c)]] = s
                else:
                    far[state * many + int(symbols[ord(c)])] = s
        tables.append(table.ravel())
        keys = np.array(sorted(far), np.int64)
        sparse.append((keys, np.array([far[k] for k in keys.tolist()], np.int32)))
        roots.append(~root)
    parser = CrossParser(list(folded), symbols, tables, np.ones(len(folded)), sparse, roots)
    for k, rows in enumerate(folded.values()):
        own = np.array([ord(c) for c in "".join(rows[1::2] or rows)], np.uint32)
        parser.norms[k] = parser.phrases(own, np.array([0, len(own)]))[0, k] / len(own)
    return parser


def fit_languages(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> CrossParser:
    """Learn from a bounded sample of rows with a language for which ``learn`` holds.

    Rows are drawn by a hash of id and text, about twice FIT_ROWS different
    ones of each language, and those with the smallest hashes are used,
    FIT_ROW_CHARS characters from a hashed place of each.
    """
    bounded_batches(docs.sparkSession)
    rows = only(docs.withColumn("_learn", learn), doc_id=doc_id, text=text, lang=lang, learn="_learn").filter(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.xxhash64("doc_id", F.lit(3), "text")
    # repeated rows count once, so that what is drawn stays bounded
    counts = {r.lang: max(r.n, 1) for r in rows.groupBy("lang").agg(F.approx_count_distinct(draw, 0.02).alias("n")).collect()}  # a row a language
    if not counts:
        return build_parser({})
    want = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(n))])
    at = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.lit(1), F.length("text") - FIT_ROW_CHARS)).cast("int")
    drawn = rows.filter(F.pmod(draw, want[F.col("lang")]) < 2 * FIT_ROWS).select("lang", draw.alias("h"), F.substring(F.col("text"), at + 1, F.lit(FIT_ROW_CHARS)).alias("text")).distinct()
    samples: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r.lang, r.h, r.text)):
        if len(samples.setdefault(r.lang, [])) < FIT_ROWS:
            samples[r.lang].append(r.text)
    return build_parser(samples)


def predict_languages(docs: DataFrame, model: CrossParser, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = shared.value.predict(texts(batch, "text"))
            return record("", doc_id=batch.column(0), lang_pred=pa.array(lang, pa.string()), score=score)

        return step

    return only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(per_batch(make), "doc_id long, lang_pred string, score double")
