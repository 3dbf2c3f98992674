"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text gets the library's dummy prefix and is cut where no piece of the vocabulary can cross: before
a run of spaces (which are the same as U+2581 here) and around newlines. All the new words of a
slice lie in one flat symbol array. Each round finds the lowest pair rank of every word by a
segmented minimum, merges the leftmost non-overlapping pairs of that rank in all words at once,
and compacts the array; words without a pair leave. Words seen before come from a bounded table.

Only models with the identity normaliser, byte fallback and no user-defined symbols are taken;
others raise ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import released, slices, texts

MARK = "▁"
#: Words kept in a worker's table before it is emptied, as it is at a partition's end; bounds the worker's memory.
TABLE_WORDS = 200_000
#: Bytes of text that are encoded at once.
SLICE = 500_000
#: Words longer than this are encoded but never kept.
LONG_WORD = 64
NEVER = np.int32(2**31 - 1)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(start, start + length) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


class Lookup:
    """Places of distinct non-negative integers: an open-addressing hash table, probed linearly and all at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, len(keys).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.place = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys)), self.slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at] < 0]
            self.place[at[self.keys[at] < 0]] = free  # of several for one slot the last stays
            self.keys[at[self.keys[at] < 0]] = keys[free]
            stay = self.keys[at] != keys[left]
            left, at = left[stay], (at[stay] + 1) & (len(self.keys) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B97F4A7C1) & 0xFFFFFFFFFFFFFFF) >> (60 - self.bits)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key among those given, -1 if it is none."""
        at = self.slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.place[at], -1)
        more = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(more):
                break
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            found = self.keys[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.place[at[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out


class Numbering(dict):
    """word -> place in the table; a word that is asked for first gets the next place and is noted in new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class PieceModel:
    """The vocabulary of a model file as arrays."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not train.byte_fallback:
            raise ValueError(f"{path}: only identity-normalised BPE models with byte fallback are supported")
        if train.treat_whitespace_as_suffix or not norm.escape_whitespaces or any(p.type == 4 for p in proto.pieces):
            raise ValueError(f"{path}: suffix white space and user-defined symbols are not supported")
        self.library = sentencepiece.__version__
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.size = len(proto.pieces)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 5)}
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in normal):
            raise ValueError(f"{path}: pieces that cross words or newlines are not supported")
        self.normal = normal
        scores = np.unique([-proto.pieces[i].score for i in normal.values()], return_counts=True)
        order = {-float(s): r for r, s in enumerate(scores[0])}
        #: Pieces of equal score merge one at a time, whichever pair is leftmost.
        self.tied = np.append(scores[1] > 1, False)
        self.char_id = np.full(0x110000, -1, np.int32)
        pairs = {}
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char_id[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = normal.get(piece[:k]), normal.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = (order[proto.pieces[i].score], i)
        self.char_id[ord(" ")] = self.char_id[ord(MARK)]
        self.pairs = Lookup(np.array(list(pairs), np.int64))
        self.pair_rank = np.array([r for r, _ in pairs.values()], np.int32)
        self.pair_id = np.array([i for _, i in pairs.values()], np.int32)
        self.byte_id = np.zeros(256, np.int32)
        surface = []
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                surface.append({2: train.unk_surface, 3: ""}.get(p.type, p.piece.replace(MARK, " ")).encode())
        self.silent = np.array([p.type == 3 for p in proto.pieces])
        # The second half of the table is for a text's first piece: the dummy prefix is taken off.
        surface += [s[1:] if self.prefix and s[:1] == b" " else s for s in surface]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        longest = max((len(p) for p in normal if not p.strip(MARK)), default=1)
        if any(re.match(f"{MARK}{MARK}+[^{MARK}]", p) for p in normal):
            raise ValueError(f"{path}: pieces with a run of white space before a word are not supported")
        self.cut = re.compile(" +[^ \n]*|[^ \n]+|\n").findall
        self.forget()
        # A run of white space fills the longest such piece again and again from the left.
        if self.encode_words([" " * longest])[1][0] == 1:
            self.cut = re.compile(f" {{{longest}}}(?= )| +[^ \n]*|[^ \n]+|\n").findall

    def forget(self) -> None:
        """Empty the table of words."""
        self.index = Numbering()
        self.flat, self.at, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def words(self, text: str) -> list[str]:
        """The words of a text, in which no piece crosses from one to the next."""
        if not text:
            return []
        if "  " in text or MARK in text or "\x01" in text or text[0] == " " or not self.prefix:
            return self.cut(self.prefix + text.replace(MARK, " "))
        return list(filter(None, (" " + text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01")).split("\x01")))

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of adjacent symbols; NEVER where they do not merge."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        at = self.pairs.find(key)
        return np.where(at < 0, NEVER, self.pair_rank[at]), self.pair_id[at]

    def encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each word)."""
        points = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sym = self.char_id[points]
        sym = np.where(sym < 0, -1 - points, sym).astype(np.int32)
        word = np.repeat(np.arange(len(new)), np.fromiter(map(len, new), np.int64, len(new)))
        done_sym, done_word = [], []
        rank = np.full(len(sym), NEVER, np.int32)
        into = np.zeros(len(sym), np.int32)
        fresh = np.arange(max(0, len(sym) - 1))
        while len(sym):
            if len(fresh):
                rank[fresh], into[fresh] = self.pair(sym[fresh], sym[fresh + 1])
                rank[fresh[word[fresh] != word[fresh + 1]]] = NEVER
            rank[-1] = NEVER
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            length = np.diff(np.append(first, len(sym)))
            lowest = np.minimum.reduceat(rank, first)
            low = np.repeat(lowest, length)
            over = low == NEVER
            hit = (rank == low) & ~over
            one = self.tied[np.minimum(low, len(self.tied) - 1)] & ~over
            if one.any():
                hit &= ~one
                at = np.flatnonzero((rank == low) & one)
                hit[at[np.unique(word[at], return_index=True)[1]]] = True
            # In a run of overlapping hits (a a a a) every second one from the left merges.
            at = np.flatnonzero(hit)
            if len(at):
                begins = np.concatenate(([True], (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])))
                nth = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[nth % 2 == 0]
            sym[at] = into[at]
            keep = ~over
            keep[at + 1] = False
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            place = np.cumsum(keep) - 1
            changed = place[at]
            sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
            stale = np.zeros(len(sym) + 1, bool)
            stale[changed] = stale[changed - 1] = True  # a -1 marks the spare last place
            fresh = np.flatnonzero(stale[: max(0, len(sym) - 1)])
            if len(sym):
                rank[changed] = NEVER
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        back = np.argsort(word, kind="stable")
        sym, word = sym[back], word[back]
        unknown = np.flatnonzero(sym < 0)
        if len(unknown):
            raw = [chr(-1 - int(x)).encode("utf-8", "surrogatepass") for x in sym[unknown]]
            n = np.ones(len(sym), np.int64)
            n[unknown] = [len(x) for x in raw]
            out, word = np.repeat(sym, n), np.repeat(word, n)
            out[out < 0] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            sym = out
        return sym, np.bincount(word, minlength=len(new))

    def learn(self, new: list[str]) -> None:
        """Append the ids of words that the table has just numbered."""
        flat, count = self.encode_words(new)
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(count) - count))
        self.flat, self.count = np.concatenate((self.flat, flat)), np.concatenate((self.count, count))

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text)."""
        if len(self.index) > TABLE_WORDS:
            self.forget()
        split = [self.words(t) for t in batch]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        every = [w for ws in split for w in ws]
        where = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        new, self.index.new = self.index.new, []
        if new:
            self.learn(new)
        counts = self.count[where]
        flat = self.flat[runs(self.at[where], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(sizes)))]
        if new and max(map(len, new)) > LONG_WORD * 64:  # unusually long words leave with the slice
            self.forget()
        return flat, np.diff(ends)

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat UTF-8 bytes, number of bytes of each text); control ids are silent."""
        ends = np.cumsum(counts)
        if ((flat < 0) | (flat >= self.size)).any():
            raise ValueError("id outside of the vocabulary")
        silent = self.silent[flat]
        if silent.any():
            gone = np.concatenate(([0], np.cumsum(silent)))
            counts = counts - (gone[ends] - gone[ends - counts])
            flat, ends = flat[~silent], np.cumsum(counts)
        row = flat.astype(np.int64)
        row[(ends - counts)[counts > 0]] += self.size
        size = self.surface_len[row]
        out = self.surface[runs(self.surface_at[row], size)]
        total = np.concatenate(([0], np.cumsum(size)))
        return out, total[ends] - total[ends - counts]


MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a path, read once in each worker."""
    if path not in MODELS:
        MODELS[path] = PieceModel(path)
    return MODELS[path]


def strings(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings from UTF-8 bytes; bytes that are no UTF-8 become U+FFFD one by one, as in the library."""
    raw = flat.tobytes()
    try:
        raw.decode()
        ok = True
    except UnicodeDecodeError:
        ok = False
    ends = np.concatenate(([0], np.cumsum(sizes)))
    if ok:
        return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
    return pa.array([mended(raw[a:b]) for a, b in zip(ends, ends[1:])], pa.string())


def mended(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, ids array<int>) per input row; a null text encodes as an empty one (no ids).

    No shuffle: rows stay in their partitions. Repeated rows give repeated results, any key type
    and null keys pass through, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        try:
            for b in slices(batches, "text", SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0), lists(*m.encode(texts(b)))], ["key", "ids"])
        finally:
            m.forget()

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(released(run), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row (key, text) per input row of (key, ids array<int>); null ids decode as an empty text.

    Ids outside of the vocabulary raise ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            column = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            counts = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), strings(*m.decode(flat, counts))], ["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (key, ids array<int>, decoded string) per input row: encode, then decode of the ids, in one pass.

    A null text is an empty one, without ids. Null keys stay, repeated rows give repeated rows, an empty
    table gives no rows; texts are whole however long; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        try:
            for b in slices(batches, "text", SLICE):
                flat, counts = m.encode(texts(b))
                yield pa.RecordBatch.from_arrays([b.column(0), lists(flat, counts), strings(*m.decode(flat, counts))], ["key", "ids", "decoded"])
        finally:
            m.forget()

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(released(run), f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)
