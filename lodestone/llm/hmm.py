"""A hidden Markov language model, trained by Baum-Welch over partitions.

Tokens are lower-cased words and one end per document. The model's symbols are the HEAD most
frequent training tokens and CLASSES classes of all the others (by their last characters), so its
size does not depend on the corpus. Within a class a token has its share of the class's count by
absolute discounting, and what the discount frees is the probability of an unseen token, which
is one token type per class, as the base score has one for all. So

    log P(text) = log P(symbols of the text) + sum over tail tokens of log P(token | class),

where the first term comes from the scaled forward recursion and is exact. Every training pass
runs over all training documents; partitions send expected counts by symbol, which are summed by
key. Counts of tail tokens never leave the executors: they meet the tokens by a join.

Documents of like length advance together, one position at a time, in flat numpy arrays.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, texts, use_checkpoints, written

STATES = 8
PASSES = 4
HEAD = 32_768
CLASSES = 512
#: Rounds in which documents are dealt to states as wholes, for the first guess of the emissions.
GUESSES = 3
#: Tokens of lower counts are never in the head, so that classes show what new tokens are like.
LEAST_COUNT = 3
END = b"\n"
#: Tokens that advance together, and bytes of packed symbols that are looked at together. The larger
#: they are, the fewer steps long documents take alone; they bound the memory of a worker.
BLOCK = 600_000
PACKED = 8_000_000


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) ASCII-white-space separated words, then the end."""
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token binary, c long): counts over all rows, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["token", "c"])

        for b in slices(batches, "text"):
            for t in texts(b):
                count.update(tokens(t))
            if len(count) > 400_000:
                yield out()
                count.clear()
        yield out()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def token_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % CLASSES


@dataclass
class Vocabulary:
    """head: token -> symbol; counts of the head symbols; totals and sizes of the tail classes; n and v of all tokens.

    discount: what a tail token's count is lowered by.
    """

    head: dict[bytes, int]
    counts: np.ndarray
    class_n: np.ndarray
    class_v: np.ndarray
    n: int
    v: int
    discount: float

    def unseen(self) -> np.ndarray:
        """P(unseen token | class); a class without tokens has no other."""
        return np.where(self.class_n > 0, self.discount * self.class_v / np.maximum(1, self.class_n), 1.0)

    @property
    def size(self) -> int:
        return len(self.head) + CLASSES

    def unigram(self) -> np.ndarray:
        """Smoothed share of every symbol."""
        c = np.concatenate((self.counts, self.class_n)) + 1.0
        return c / c.sum()


def cutoff(sizes: DataFrame, most: int, least: int = 1) -> int:
    """The lowest count, least at any rate, that at most so many tokens reach; sizes has (c, n tokens of that count).

    The range of counts is cut into 256 parts again and again, so 256 rows at most reach the driver.
    """
    top = sizes.agg(F.max("c")).collect()[0][0] or 0
    low, high, above = least, max(least, top + 1), 0  # more than most tokens may reach low; above tokens reach high, at most most
    while low < high:
        step = -(-(high - low) // 256)
        part = F.floor((F.col("c") - low) / step)
        n = {r.k: r.n for r in sizes.where((F.col("c") >= low) & (F.col("c") < high)).groupBy(part.alias("k")).agg(F.sum("n").alias("n")).collect()}
        edge = -(-(high - low) // step)
        while edge > 0 and above + n.get(edge - 1, 0) <= most:
            edge -= 1
            above += n.get(edge, 0)
        if not edge or step == 1:
            return low + edge * step
        low, high = low + (edge - 1) * step, min(high, low + edge * step)
    return high


def vocabulary(counted: DataFrame, head: int = HEAD) -> Vocabulary:
    """The head and the class sums of a counts table; head + CLASSES rows reach the driver.

    The head has the tokens from the lowest count on that at most head tokens reach, so ties are in it
    together or not at all, and no task sends more than belongs to it.
    """
    sizes = counted.groupBy("c").agg(F.count("*").alias("n")).checkpoint()
    least = cutoff(sizes, head, LEAST_COUNT)
    top = sorted(counted.where(F.col("c") >= least).collect(), key=lambda r: (-r.c, bytes(r.token)))
    symbols = {bytes(r.token): k for k, r in enumerate(top)}
    of = lambda c: F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), F.lit(0))
    total = sizes.agg(F.coalesce(F.sum(F.col("c") * F.col("n")), F.lit(0)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("v"), of(1).alias("once"), of(2).alias("twice")).collect()[0]
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counted.groupBy(_class(F.col("token")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r.k], v[r.k] = r.n, r.v
    for r in top:
        k = token_class(bytes(r.token))
        n[k] -= r.c
        v[k] -= 1
    return Vocabulary(symbols, np.array([r.c for r in top], float), n, v, int(total.n), int(total.v), min(0.95, max(0.05, (total.once + 1) / (total.once + 2 * total.twice + 2))))


def _class(token: Column) -> Column:
    """token_class as a column."""
    last = F.substring(token, F.greatest(F.lit(1), F.octet_length(token) - 2), F.lit(3))
    return (F.crc32(last) % CLASSES).cast("int")


@dataclass
class Model:
    """start [K], step [K, K], emit [K, S]: probabilities."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @cached_property
    def by_symbol(self) -> np.ndarray:
        return np.ascontiguousarray(self.emit.T)


def blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of sequences that advance together, by falling length."""
    order = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, BLOCK // max(1, int(lengths[order[at]])))
        yield order[at : at + n]
        at += n


def forward(model: Model, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """Scaled forward recursion over sequences sorted by falling length.

    Returns log2-free natural logs of the sequences' probabilities, and with keep the scaled
    alphas and scales of every position (time-major, flat).
    """
    out, alphas, scales, live_at = np.zeros(len(starts)), [], [], []
    emit, ones = model.by_symbol, np.ones(len(model.start))
    a = None
    live = len(starts)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        while lengths[live - 1] <= t:
            live -= 1
        seen = np.take(emit, ids[starts[:live] + t], axis=0)
        a = np.multiply(model.start if t == 0 else a[:live] @ model.step, seen, out=seen)
        c = a @ ones
        a /= c[:, None]
        out[:live] += np.log(c)
        if keep:
            alphas.append(a)
            scales.append(c)
            live_at.append(live)
    return (out, alphas, scales, live_at) if keep else out


def expected(model: Model, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, into: Model) -> float:
    """Add a block's expected counts to into; the block's log likelihood."""
    logs, alphas, scales, live_at = forward(model, ids, starts, lengths, keep=True)
    emit = model.by_symbol
    k = len(model.start)
    beta = np.ones((0, k))
    symbols, gammas = [], []
    for t in range(len(alphas) - 1, -1, -1):
        live = live_at[t]
        if t + 1 < len(alphas):
            nxt = live_at[t + 1]
            ahead = np.take(emit, symbols[-1], axis=0)
            ahead *= beta
            ahead /= scales[t + 1][:, None]
            into.step[:] += model.step * (alphas[t][:nxt].T @ ahead)
            beta = ahead @ model.step.T
        if live > len(beta):
            beta = np.concatenate((beta, np.ones((live - len(beta), k))))
        symbols.append(ids[starts[:live] + t])
        gammas.append(np.multiply(alphas[t], beta, out=alphas[t]))
    into.start[:] += gammas[-1].sum(0)
    s, g = np.concatenate(symbols), np.concatenate(gammas)
    for j in range(k):
        into.emit[j] += np.bincount(s, weights=g[:, j], minlength=into.emit.shape[1])
    return float(logs.sum())


def _packed(batch: pa.RecordBatch, column: str = "ids") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat symbols, starts, lengths) of a binary column of uint16."""
    raw = batch.column(batch.schema.get_field_index(column)).to_pylist()
    lengths = np.array([len(x) // 2 for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), np.uint16).astype(np.int64), np.cumsum(lengths) - lengths, lengths


def first_guess(seqs: DataFrame, vocab: Vocabulary, states: int, seed: int = 1) -> Model:
    """States from whole documents, dealt to them by all rows of seqs: first by the signs of seeded
    projections of their symbol shares, then GUESSES - 1 times by the state whose distribution makes
    them likeliest. A state's emissions are its documents' symbols and the whole's, which is all that
    a state without documents has."""
    rng = np.random.default_rng(seed)
    sc, size, whole = seqs.sparkSession.sparkContext, vocab.size, vocab.unigram()
    bits = max(1, (states - 1).bit_length())
    weight = rng.standard_normal((size, bits)) / np.sqrt(whole)[:, None]
    weight -= whole @ weight
    noise = np.exp(0.05 * rng.standard_normal((states, size)))
    emit = whole * noise
    for k in range(GUESSES):
        shared = sc.broadcast(np.ascontiguousarray(np.log(emit / emit.sum(1, keepdims=True)).T if k else weight, np.float32))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            w, total = shared.value, np.zeros(states * size)
            for b in slices(batches, "ids", PACKED):
                ids, starts, lengths = _packed(b)
                each, doc = np.zeros((len(starts), w.shape[1])), np.repeat(np.arange(len(starts)), lengths)
                for at in range(0, len(ids), BLOCK):
                    first = np.flatnonzero(np.diff(doc[at : at + BLOCK], prepend=-1))
                    each[doc[at + first]] += np.add.reduceat(w[ids[at : at + BLOCK]], first)
                state = each.argmax(1) if k else (each > 0) @ (1 << np.arange(bits)) % states
                total += np.bincount(np.repeat(state, lengths) * size + ids, minlength=states * size)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

        out = np.zeros(states * size)  # as many rows at most reach the driver, however many partitions there are
        for r in seqs.select("ids").mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).collect():
            out[r.slot] = r.n
        out = out.reshape(states, size)
        # Each state has at least as much of the whole as keeps every symbol possible.
        emit = (out + np.maximum(1, (out > 0).sum(1, keepdims=True)) * whole) * noise
        shared.unpersist()
    emit = 0.6 * emit / emit.sum(1, keepdims=True) + 0.4 * whole
    step = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(step, 0.9)
    return Model(np.full(states, 1 / states), step, emit)


def normalised(counts: Model, vocab: Vocabulary) -> Model:
    """Probabilities from expected counts; the corpus-wide distribution weighs as much in a state's as the
    state has symbols (Witten and Bell), so that nothing is impossible."""
    k = len(counts.start)
    emit = counts.emit + np.maximum(1, (counts.emit > 0.1).sum(1, keepdims=True)) * vocab.unigram()
    step = counts.step + 0.5 / k
    start = counts.start + 0.5 / k
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def sequences(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, key, held_out, n_tokens, ids binary, tail array<binary>, tail_n array<int>) of (key, held_out, text).

    ids are uint16 symbols; tail holds the tokens outside of the head, tail_n how often they come. row
    numbers the rows of a task and is only meaningful once the result is written.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        get, head = v.head.get, len(v.head)
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches, "text"):
            ids, tails, counts, n = [], [], [], []
            for t in texts(b):
                words = tokens(t)
                found = [get(w, -1) for w in words]
                tail = [w for w, s in zip(words, found, strict=True) if s < 0]
                if tail:
                    codes = iter([head + token_class(w) for w in tail])
                    found = [s if s >= 0 else next(codes) for s in found]
                ids.append(np.array(found, np.uint16).tobytes())
                each = Counter(tail)
                tails.append(list(each))
                counts.append(list(each.values()))
                n.append(len(words))
            rows = np.arange(row, row + len(n))
            row += len(n)
            yield pa.RecordBatch.from_arrays([pa.array(rows), b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(tails, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32()))], ["row", "key", "held_out", "n_tokens", "ids", "tail", "tail_n"])

    return docs.select("key", "held_out", "text").mapInArrow(run, f"row long, key {kind}, held_out boolean, n_tokens long, ids binary, tail array<binary>, tail_n array<int>")


def train(seqs: DataFrame, vocab: Vocabulary, states: int = STATES, passes: int = PASSES) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows of seqs (ids binary); the model and the log likelihood before each pass."""
    sc = seqs.sparkSession.sparkContext
    model, logs = first_guess(seqs, vocab, states), []
    size = vocab.size
    schema = ", ".join(["slot long", *(f"v{j} double" for j in range(states))])
    for _ in range(passes):
        shared = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            into = Model(np.zeros(states), np.zeros((states, states)), np.zeros((states, size)))
            log = 0.0
            for b in slices(batches, "ids", PACKED):
                ids, starts, lengths = _packed(b)
                for block in blocks(lengths):
                    log += expected(m, ids, starts[block], lengths[block], into)
            # Slots: symbols, then the rows of step, then start, then the log likelihood.
            rows = np.concatenate((into.emit.T, into.step, into.start[None], np.full((1, states), log)))
            at = np.flatnonzero(rows.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(rows[at, j]) for j in range(states))], ["slot", *(f"v{j}" for j in range(states))])

        # size + states + 2 rows reach the driver, however many partitions there are.
        out = np.zeros((size + states + 2, states))
        for r in seqs.select("ids").mapInArrow(run, schema).groupBy("slot").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(states))).collect():
            out[r.slot] = r[1:]
        logs.append(float(out[-1, 0]))
        model = normalised(Model(out[-2], out[size : size + states], out[:size].T.copy()), vocab)
        shared.unpersist()
    return model, logs


def language_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", states: int = STATES, passes: int = PASSES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per input row.

    The model and all counts come from rows where held_out is false (null counts as false). Scores
    are log10 probabilities: base_score of the smoothed unigrams, score of the hidden Markov model.
    A null or blank text has one token, its end. Repeated rows each count, and null keys are keys like
    any other. Very long texts are whole; a task holds one at a time with its forward variables. Without
    training rows every token is unseen, and symbols are equally likely. An empty table gives no rows;
    other columns are not looked at.
    """
    use_checkpoints(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    counted = token_counts(rows.where(~F.col("held_out"))).checkpoint()
    vocab = vocabulary(counted)
    seqs = sequences(rows, vocab).checkpoint()
    learnt, delete = written(seqs.where(~F.col("held_out")).select("ids"))  # read again and again, without the tails
    try:
        model, _ = train(learnt, vocab, states, passes)
    finally:
        delete()
    shared = docs.sparkSession.sparkContext.broadcast((model, vocab))
    unit = math.log10(vocab.n + vocab.v + 1)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, v = shared.value
        base = np.concatenate((np.log10(v.counts + 1) - unit, np.zeros(CLASSES)))
        for b in slices(batches, "ids", PACKED):
            ids, starts, lengths = _packed(b)
            logs = np.zeros(len(lengths))
            for block in blocks(lengths):
                logs[block] = forward(m, ids, starts[block], lengths[block])
            ends = np.concatenate(([0], np.cumsum(base[ids])))
            known = np.concatenate(([0], np.cumsum(ids < len(v.head))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(known[starts + lengths] - known[starts]), pa.array(ends[starts + lengths] - ends[starts]), pa.array(logs / math.log(10))],
                ["row", "key", "held_out", "n_tokens", "known", "base", "log"],
            )

    heads = seqs.select("row", "key", "held_out", "n_tokens", "ids").mapInArrow(run, f"row long, key {kind}, held_out boolean, n_tokens long, known long, base double, log double")
    tail = seqs.select("row", F.inline(F.arrays_zip(F.col("tail").alias("token"), F.col("tail_n").alias("n"))))
    c = F.coalesce("c", F.lit(0))
    by_class = lambda a: F.element_at(F.array(*(F.lit(float(x)) for x in a)), _class(F.col("token")) + 1)
    within = F.when(c > 0, (c - vocab.discount) / by_class(np.maximum(1, vocab.class_n))).otherwise(by_class(vocab.unseen()))
    tails = (
        tail.join(counted, "token", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("n") * (F.log10(c + 1) - unit)).alias("tail_base"),
            F.sum(F.col("n") * F.log10(within)).alias("tail_log"),
        )
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return heads.join(tails, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + zero("tail_known")).cast("long").alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base")).alias("base_score"),
        (F.col("log") + zero("tail_log")).alias("score"),
    )
