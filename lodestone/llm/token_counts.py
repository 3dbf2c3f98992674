"""Exact token counts of every prefix by dynamic programming over pieces.

The encoding of a prefix ends with one token, and what stands before it is the encoding of a
shorter prefix. So the DP keeps, for every prefix of a word, its last token and its count, and
extends by the token whose pair with the last token before it is itself an encoding (encoding the
two surfaces together gives the same two tokens). All new words of a slice advance together, one
position at a time. A position where not exactly one token fits is encoded directly, so counts
are exact for any vocabulary. Prefix counts answer how many tokens a truncated text has and where
to cut for a budget without encoding again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, texts
from lodestone.llm.pieces import LONG_WORD, TABLE_WORDS, Lookup, Numbering, lists, model, runs

#: The last token of an empty prefix, and of one that ends in byte-fallback tokens: nothing merges with it.
OPEN = -1
#: Pairs of tokens that a worker remembers at most.
TABLE_PAIRS = 1_000_000


class PrefixCounter:
    """Prefix counts of words, kept in a bounded table."""

    def __init__(self, path: str):
        self.model = m = model(path)
        self.text = {i: p.replace("▁", " ") for p, i in m.normal.items()}
        letters = sorted({c for p in self.text.values() for c in p})
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letter[0x2581] = self.letter[ord(" ")]
        self.width = len(letters)
        nodes, tokens = {(): 0}, [-1]
        steps: dict[int, int] = {}
        for i, p in self.text.items():
            at = 0
            for c in p:
                step = at * self.width + int(self.letter[ord(c)])
                if step not in steps:
                    steps[step] = len(tokens)
                    tokens.append(-1)
                at = steps[step]
            tokens[at] = i
        self.steps, self.step_to = Lookup(np.array(list(steps), np.int64)), np.array(list(steps.values()), np.int64)
        self.node_token = np.array(tokens, np.int64)
        pieces = list(self.text)
        flat, n = m.encode_words([self.text[i] for i in pieces])
        whole = np.zeros(m.size, bool)
        single = n == 1
        whole[np.array(pieces)[single]] = flat[(np.cumsum(n) - n)[single]] == np.array(pieces)[single]
        #: Pieces that are their own encoding.
        self.whole = whole
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.index, self.huge = Numbering(), False
        self.flat, self.at, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether (before, token) is an encoding; after OPEN the token has to be one alone."""
        out = self.whole[token].copy()
        at = np.flatnonzero(before >= 0)
        keys, where = np.unique(before[at] * self.model.size + token[at], return_inverse=True)
        known = self.pairs
        if len(known) > TABLE_PAIRS:
            known.clear()
        new = [k for k in keys.tolist() if k not in known]
        if new:
            a, b = np.divmod(np.array(new), self.model.size)
            flat, n = self.model.encode_words([self.text[x] + self.text[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            first = np.cumsum(n) - n
            two = n == 2
            good = np.zeros(len(new), bool)
            good[two] = (flat[first[two]] == a[two]) & (flat[first[two] + 1] == b[two])
            known.update(zip(new, good.tolist(), strict=True))
        out[at] = np.fromiter((known[k] for k in keys.tolist()), bool, len(keys))[where]
        return out

    def count_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat counts of the prefixes of 1, 2, ... code points, number of code points) of each word."""
        size = np.fromiter(map(len, new), np.int64, len(new))
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        end, base = np.cumsum(size), np.cumsum(size) - size
        word = np.repeat(np.arange(len(new)), size)
        stop = end[word]
        letter = self.letter[points].astype(np.int64)
        # Walk the trie from every position at once; the walks that stay alive give the matches.
        start, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        found = []
        depth = 0
        while len(start):
            here = start + depth
            ok = here < stop[start]
            start, node, here = start[ok], node[ok], here[ok]
            key = np.where(letter[here] >= 0, node * self.width + letter[here], -2)
            to = self.steps.find(key)
            start, node = start[to >= 0], self.step_to[to[to >= 0]]
            depth += 1
            token = self.node_token[node]
            hit = token >= 0
            found.append((start[hit], np.full(int(hit.sum()), depth), token[hit]))
        first, length, token = (np.concatenate(x) for x in zip(*found, strict=True))
        # Slot k + word index is the state before character k of the flat array.
        last = np.full(len(points) + len(new), OPEN, np.int64)
        count = np.zeros(len(points) + len(new), np.int32)
        state = np.arange(len(points)) + word
        finish = first + length - 1 - base[word[first]]
        by = np.argsort(finish, kind="stable")
        first, length, token, finish = first[by], length[by], token[by], finish[by]
        edge = np.searchsorted(finish, np.arange(int(size.max()) + 1))
        raw = self.model.char_id[points] < 0
        spare = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        for i in range(int(size.max())):
            f, n, t = first[edge[i] : edge[i + 1]], length[edge[i] : edge[i + 1]], token[edge[i] : edge[i + 1]]
            live = base[size > i] + i
            if len(f):
                good = self.fits(last[state[f]], t)
                f, n, t = f[good], n[good], t[good]
                last[state[f] + n], count[state[f] + n] = t, count[state[f]] + 1
            fitting = np.bincount(word[f], minlength=len(new))[word[live]] if len(f) else np.zeros(len(live), np.int64)
            fall = live[raw[live] & (fitting == 0)]
            count[state[fall] + 1] = count[state[fall]] + spare[fall]
            odd = live[(fitting != 1) & ~(raw[live] & (fitting == 0))]
            for at in odd.tolist():
                w = int(word[at])
                ids, _ = self.model.encode_words([new[w][: i + 1]])
                last[state[at] + 1], count[state[at] + 1] = ids[-1] if ids[-1] in self.text else OPEN, len(ids)
        return count[state + 1], size

    def places(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(table place of every word, number of words of each text)."""
        if len(self.index) > TABLE_WORDS or self.huge:  # unusually long words leave with their slice
            self.forget()
        split = [self.model.words(t) for t in batch]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        where = np.fromiter((self.index[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
        new, self.index.new = self.index.new, []
        if new:
            by = sorted(range(len(new)), key=lambda k: len(new[k]))  # words of like length advance together
            flat, size = [], np.zeros(len(new), np.int64)
            for k in range(0, len(by), 50_000):
                part = by[k : k + 50_000]
                counts, n = self.count_words([new[x] for x in part])
                flat.append(counts)
                size[part] = n
            at = np.zeros(len(new), np.int64)
            at[by] = np.cumsum(size[by]) - size[by]
            self.at = np.concatenate((self.at, len(self.flat) + at))
            self.flat = np.concatenate((self.flat, *flat))
            self.size = np.concatenate((self.size, size))
            self.huge = max(map(len, new)) > LONG_WORD * 64
        return where, sizes

    def count(self, batch: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of each text, code points of its longest prefix of at most limit tokens)."""
        where, sizes = self.places(batch)
        whole = self.flat[self.at[where] + self.size[where] - 1].astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(whole)))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        total = sums[ends[1:]] - sums[ends[:-1]]
        fit = np.fromiter(map(len, batch), np.int64, len(batch))
        for k in np.flatnonzero(total > limit).tolist():
            counts = self.prefixes(where[ends[k] : ends[k + 1]])
            fit[k] = np.flatnonzero(counts <= limit)[-1]
        return total, fit

    def prefixes(self, where: np.ndarray) -> np.ndarray:
        """Tokens of the prefixes of 0, 1, 2, ... code points of the text with these words."""
        if not len(where):
            return np.zeros(1, np.int64)
        size = self.size[where]
        inner = self.flat[runs(self.at[where], size)].astype(np.int64)
        whole = self.flat[self.at[where] + size - 1].astype(np.int64)
        counts = inner + np.repeat(np.cumsum(whole) - whole, size)
        return np.concatenate(([0], counts[len(self.model.prefix) :]))


COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in COUNTERS:
        COUNTERS[path] = PrefixCounter(path)
    return COUNTERS[path]


def token_counts(df: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, n_tokens long, fitting_chars long) per input row.

    fitting_chars: code points of the longest prefix with at most limit tokens. A null text counts
    as an empty one (0 tokens). No shuffle; null keys stay, repeated rows give repeated rows, and other
    columns are not looked at. Texts are whole however long, one at a time; an empty table gives no rows.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, "text"):
            total, fit = c.count(texts(b), limit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total), pa.array(fit)], ["key", "n_tokens", "fitting_chars"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, fitting_chars long").withColumnRenamed("key", key)


def prefix_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, counts array<int>) per input row: counts[p] is the number of tokens of the text's
    first p code points, for every p from 0 to the text's length. A null text gives [0]; null keys stay,
    repeated rows give repeated rows, an empty table gives no rows; texts are whole however long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches, "text"):
            where, sizes = c.places(texts(b))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            each = [c.prefixes(where[x:y]) for x, y in zip(ends, ends[1:])]
            n = np.array([len(x) for x in each], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(np.concatenate(each), n)], ["key", "counts"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, counts array<int>").withColumnRenamed("key", key)
