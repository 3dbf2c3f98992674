"""Toxicity of deobfuscated text.

A token that hides a word (leetspeak, letters set apart, stretched letters) is a noisy
observation. Its characters form a lattice: each segment offers letters that it may stand for,
with a channel cost; a character trigram model of the whole corpus scores the paths, and Viterbi
decoding restores the likeliest word. Restored words are then scored: features (the word, its
beginnings and ends) are weighed by how often labelled documents that have them are toxic. The
strongest sign of a document and the sum of its others give a probability by a logistic model over
the labelled rows, so that many faint signs do not outweigh the lack of a strong one.

fit() counts character trigrams over all documents and features over labelled rows, at most
SAMPLE of them (those of lowest id hash), of which only features with significant evidence (and
their special cases) are kept. The sample bounds what the driver and the workers hold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lowest, released, slices, texts

#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 40_000
#: Documents with a score from here on are rejected.
THRESHOLD = 0.3
TABLE_WORDS = 300_000

#: Letters that a symbol or digit may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Costs (negative log probabilities) of the channel: a symbol stands for a letter, means nothing, a leet symbol means nothing; stretches, doublings.
SUBSTITUTED, SKIPPED, DROPPED, STRETCHED, DOUBLED = 1.0, 2.5, 5.0, 0.5, 1.2
SEPARATORS = ".-_*~'`/\\,·"
#: Cost of a word's end between letters set apart; that of the end itself is the language model's.
CUT = 0.5
EDGES = ".,;:?\"'()[]{}<>«»“”„…"
#: Letters of the language model: 0 is a word's edge, 1-26 a-z, 27 any other letter.
ALPHABET = 28


def folded(points: np.ndarray) -> np.ndarray:
    """Model letters of lower-case code points: accents go, other letters are 27, the rest are edges."""
    small, where = np.unique(points, return_inverse=True)
    letters = np.zeros(len(small), np.int64)
    for k, p in enumerate(small.tolist()):
        c = chr(p)
        if c.isalpha():
            base = unicodedata.normalize("NFD", c)[0]
            letters[k] = ord(base) - 96 if "a" <= base <= "z" else 27
    return letters[where]


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else int(folded(np.array([ord(c)]))[0])


def trigram_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of the letter trigrams of all texts, as an array of ALPHABET^3 (at most that many rows reach the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for b in slices(batches, "text", 500_000):
            points = np.frombuffer("  ".join(["", *texts(b), ""]).lower().encode("utf-32-le", "surrogatepass"), "<u4")
            c = folded(points)
            total += np.bincount((c[:-2] * ALPHABET + c[1:-1]) * ALPHABET + c[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(ALPHABET**3, np.int64)
    for r in df.select(F.col(text).alias("text")).mapInArrow(released(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.gram] = r.n
    return out


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """-log P(third | first two) [ALPHABET, ALPHABET, ALPHABET], interpolated with the bigram and unigram."""
    three = counts.reshape(ALPHABET, ALPHABET, ALPHABET).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + ALPHABET)
    p2 = (two + 10 * p1) / (two.sum(1, keepdims=True) + 10)
    return -np.log((three + 10 * p2[None]) / (three.sum(2, keepdims=True) + 10))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Segments of a lower-case token, each with the strings it may stand for and their costs."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if c in LEET:
            ways = [(x * k, SUBSTITUTED + (k - 1) * DOUBLED) for x in LEET[c] for k in {1, min(n, 2)}]
            out.append([*ways, ("", DROPPED)])
        elif not c.isalpha():
            out.append([("", 0.0 if c in SEPARATORS else SKIPPED)])
        elif n == 1:
            out.append([(c, 0.0)])
        else:  # a doubled letter is common; more are a stretch of one or two
            out.append([(c, STRETCHED + (n == 2) * DOUBLED), (c * 2, 0.0 if n == 2 else STRETCHED)])
    return out


def spaced_lattice(letters: str) -> list[list[tuple[str, float]]]:
    """Segments of letters set apart, with a segment between any two of them where a word may end."""
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"(.)\1*", letters, re.S):
        ways = lattice(m[0])[0]
        if len(m[0]) > 1 and m[1] not in LEET:  # the first of two equal letters may end a word
            ways = [*ways, (f"{m[1]} {m[1]}", CUT + (len(m[0]) > 2) * STRETCHED)]
        out += [ways, [("", 0.0), (" ", CUT)]]
    return out[:-1]


def windows(ways: list[list[tuple[str, float]]], costs: np.ndarray, near: float) -> list[str]:
    """The words on the best paths through a lattice with word cuts, those of the likeliest path first.

    Long lattices are decoded in windows of LONGEST segments that overlap by half; a word that
    touches the edge of a window inside of the lattice may be a part and is left to the next window.
    """
    found: dict[str, None] = {}
    for start in range(0, max(1, len(ways) - LONGEST // 2), LONGEST // 2):
        inside = [start > 0, start + LONGEST < len(ways)]
        for path in walk(ways[start : start + LONGEST], costs, near):
            parts = path.split(" ")
            found.update(dict.fromkeys(x for x in parts[inside[0] : len(parts) - inside[1]] if x))
    return list(found)


def decode(token: str, costs: np.ndarray, near: float = 0.0, paths: int = 8) -> list[str]:
    """The likeliest words behind a token, best first: those that cost at most near more than the best."""
    return walk(lattice(token), costs, near, paths)


def walk(lattice: list[list[tuple[str, float]]], costs: np.ndarray, near: float = 0.0, paths: int = 8) -> list[str]:
    """The likeliest strings through a lattice, best first: those that cost at most near more than the best.

    Viterbi; states are the last two letters, and each keeps some paths. The likeliest string is
    exact; others are missing where more than so many come to one state.
    """
    best: dict[tuple[int, int], list[tuple[float, str]]] = {(0, 0): [(0.0, "")]}
    for ways in lattice:
        step: dict[tuple[int, int], dict[str, float]] = {}
        for state, entries in best.items():
            for string, extra in ways:
                (a, b), more = state, extra
                for c in string:
                    k = _letter(c)
                    more += costs[a, b, k]
                    a, b = b, k
                to = step.setdefault((a, b), {})
                for cost, word in entries:
                    if cost + more < to.get(word + string, math.inf):
                        to[word + string] = cost + more
        best = {s: sorted((c, w) for w, c in to.items())[:paths] for s, to in step.items()}
    ends: dict[str, float] = {}
    for (a, b), entries in best.items():
        for cost, word in entries:
            ends[word] = min(ends.get(word, math.inf), cost + costs[a, b, 0])
    order = sorted((c, w) for w, c in ends.items())
    return [w for c, w in order if c <= order[0][0] + near]


HIDDEN = re.compile(rf"[^\W\d_][{re.escape(''.join(LEET) + SEPARATORS)}]+[^\W\d_]|[{re.escape(''.join(LEET))}][^\W\d_]|[^\W\d_][{re.escape(''.join(LEET))}]|([^\W\d_])\1\1")
#: A letter with an equal one beside it: one of them may be meant.
TWICE = re.compile(r"([^\W\d_])\1")
#: Letters set apart, with punctuation around them at most.
SPACED = re.compile(rf"(?<![^\s{re.escape(EDGES)}])(?:[^\W_]|[@$!|+])(?:[\s.*_-]{{1,2}}(?:[^\W_]|[@$!|+])){{2,}}(?=[!{re.escape(EDGES)}]*(?!\S))")
DECORATED = re.compile(r"^([!$%&*#+|])\1+|([!$%&*#+|])\2+$")


#: Words that cost at most so much more than the likeliest one are scored as well.
NEAR = 8.0


def restored(token: str, costs: np.ndarray, near: float = 0.0) -> list[str]:
    """The words of a lower-case token, likeliest first: edges off, decoded if something seems hidden in it.

    Letters set apart come with single spaces between them and may be several words. A doubled
    letter is only tried as one where words beside the likeliest are asked for.
    """
    if " " in token:
        return windows(spaced_lattice(token.replace(" ", "")), costs, near) or [""]
    core = token.strip(EDGES)
    for _ in range(2):
        core = DECORATED.sub("", core).strip(EDGES)
    plain = core.strip("!$%&*#+|-_")
    if not HIDDEN.search(core):
        return undoubled(plain) if near and TWICE.search(plain) else [plain]
    ways = lattice(core)
    if len(ways) <= LONGEST:
        return walk(ways, costs, near)
    # More than one word: words end at separators, and what lies between them may hide one as well.
    ways = [[*w, *((" ", c + CUT) for x, c in w)] if [x for x, _ in w] == [""] else w for w in ways]
    pieces = [x for x in re.split(f"[{re.escape(SEPARATORS)}]+", core) if 1 < len(x) < len(core)]
    return list(dict.fromkeys([plain, *windows(ways, costs, near), *(w for x in pieces for w in restored(x, costs, near))]))


def undoubled(word: str) -> list[str]:
    """A word whose only stretches are doubled letters, with each of them as two or as one: itself, then the others."""
    at, out = [m.start() for m in TWICE.finditer(word)], [word]
    if len(at) > MOST_DOUBLED:  # no word has so many: all or none are meant
        return [word, TWICE.sub(r"\1", word)]
    for k in reversed(at):
        out += [x[:k] + x[k + 1 :] for x in out]
    return out


#: Doubled letters of one word that are taken one by one.
MOST_DOUBLED = 6
#: Segments of the longest lattice that is decoded at once, stretches being one segment.
LONGEST = 64


def restore(token: str, costs: np.ndarray) -> list[str]:
    """The likeliest word of a token; those of letters set apart and of a very long token."""
    found = restored(token, costs)
    return found if found and (" " in token or len(token) > LONGEST) else found[:1]


#: Lengths of the beginnings and ends that are features of longer words.
BEGINNINGS, ENDS = (3, 4, 5, 6), (4, 5)
#: Documents that a feature needs to be looked at, and the weight of the broader feature beside its own counts.
LEAST, PRIOR = 4, 4.0


def features(word: Column) -> Column:
    """Features of a restored word: itself, and beginnings and ends that are shorter than it."""
    n = F.length(word)
    parts = [F.when(n > k, F.concat(F.lit("^"), F.substring(word, 1, k))) for k in BEGINNINGS]
    parts += [F.when(n > k, F.concat(F.substring(word, F.lit(1) + n - k, F.lit(k)), F.lit("$"))) for k in ENDS]
    return F.array_compact(F.array(F.when(n > 2, word), *parts))


def broader(feature: Column) -> Column:
    """Features of which this one is a special case, itself included."""
    plain = F.translate(feature, "^$", "")
    n = F.length(plain)
    begins = [F.when((n >= k) & ~feature.endswith("$"), F.concat(F.lit("^"), F.substring(plain, 1, k))) for k in BEGINNINGS]
    ends = [F.when((n >= k) & ~feature.startswith("^"), F.concat(F.substring(plain, F.lit(1) + n - k, F.lit(k)), F.lit("$"))) for k in ENDS]
    return F.array_compact(F.array(feature, *begins, *ends))


def chains(word: str) -> list[list[str]]:
    """The word's features from broad to special: by its beginnings, and by its ends."""
    n, whole = len(word), [word] if len(word) > 2 else []
    return [[f"^{word[:k]}" for k in BEGINNINGS if n > k] + whole, [f"{word[-k:]}$" for k in ENDS if n > k] + whole]


@dataclass
class Toxicity:
    """A fitted model.

    costs: letter trigram costs. counts: feature -> (documents, toxic ones, whether it is a
    significant sign). base: share of toxic documents; residual: that of documents without a sign.
    line: intercept of the log odds and their slopes over a document's strongest sign and its others together,
    for documents with a sign.
    """

    costs: np.ndarray
    counts: dict[str, tuple[int, int, bool]]
    base: float
    residual: float
    line: tuple[float, float, float] = (-2.0, 1.0, 0.0)

    def probability(self, evidence: tuple[float, float]) -> float:
        if not evidence[0]:
            return self.residual
        odds = self.line[0] + self.line[1] * evidence[0] + self.line[2] * evidence[1]
        return max(self.residual, 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))

    def words(self, text: str) -> set[str]:
        """Tokens to look up: lower-cased words, and runs of single letters put together."""
        low = text.lower()
        out = set(low.split())
        out.update(" ".join(re.sub(r"[\s.*_-]", "", m)) for m in SPACED.findall(low))
        return out

    def rate(self, token: str) -> float:
        """The share of toxic documents that a token's most special features show, 0 if it is no sign.

        Along a chain each feature's share is shrunk towards that of the broader one before it.
        """
        best = 0.0
        for chain in (c for word in restored(token, self.costs, NEAR) for c in chains(word)):
            share, sign = self.base, False
            for f in chain:
                if f in self.counts:
                    n, y, strong = self.counts[f]
                    share, sign = (y + PRIOR * share) / (n + PRIOR), sign or strong
            best = max(best, share if sign else 0.0)
        return best if best >= 0.5 else 0.0


#: The sum of a text's other signs stops here; probabilities are fitted in steps of 1/STEPS of evidence.
MOST_EVIDENCE = 30.0
STEPS = 10


class Evidence(dict):
    """token -> -log(1 - rate), found once, in a bounded table."""

    def __init__(self, model: Toxicity):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        found = self[token] = -math.log(1 - min(0.999, self.model.rate(token)))
        return found

    def of(self, text: str) -> tuple[float, float]:
        """(the strongest sign, the sum of the others)."""
        if len(self) > TABLE_WORDS:
            self.clear()
        signs = list(map(self.__getitem__, self.model.words(text)))
        most = max(signs, default=0.0)
        return most, min(MOST_EVIDENCE, math.fsum(signs) - most)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Toxicity:
    """A model from labelled rows (key, label 0 or 1) of docs; rows with a null key or label are not used.

    Hold rows out by leaving them out of labels. Repeated labels of a key count once, and the
    larger one holds. Without labelled rows the model has no features and a residual of 0.
    """
    costs = letter_costs(trigram_counts(docs, text))
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    # At most SAMPLE rows of an id and a bit: the bound that allows the broadcast.
    chosen = lowest(known, F.xxhash64("key"), SAMPLE)
    sample = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    # Copies of a text are one observation: what else is in them would be a sign by their number alone.
    sample = sample.groupBy(F.xxhash64("text").alias("hash")).agg(F.max("label").alias("label"), F.first("text").alias("text")).select("label", "text")
    bare = Toxicity(costs, {}, 0.0, 0.0)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, number of documents, number of toxic ones), summed over each slice; the word '' counts the documents."""
        plain: dict[str, list[str]] = {}
        for b in slices(batches, "text"):
            count: dict[str, list[int]] = {}
            if len(plain) > TABLE_WORDS:
                plain = {}
            for t, y in zip(texts(b), b.column(0).to_pylist(), strict=True):
                mine = {""}
                for token in bare.words(t):
                    if token not in plain:
                        plain[token] = restore(token, costs)
                    mine.update(plain[token])
                for w in mine:
                    n = count.setdefault(w, [0, 0])
                    n[0] += 1
                    n[1] += y
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([n for n, _ in count.values()], pa.int64()), pa.array([y for _, y in count.values()], pa.int64())], ["word", "n", "y"])

    counted = sample.mapInArrow(released(words), "word string, n long, y long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).persist()
    try:
        total = counted.where("word = ''").collect()
        n, y = (total[0].n, total[0].y) if total else (0, 0)
        if not 0 < y < n:
            return Toxicity(costs, {}, float(y > 0), float(y > 0))
        base = y / n
        by = counted.where("word <> ''").select(F.explode(features(F.col("word"))).alias("f"), "n", "y").groupBy("f").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where(F.col("n") >= LEAST).persist()
        p = F.col("y") / F.col("n")
        rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - base))).otherwise(0.0)
        # The chance of so many toxic ones is below exp(-evidence); it has to be rare among all the features tried.
        tried = by.count()
        strong = by.where(p > max(0.5, 2 * base)).withColumn("evidence", F.col("n") * (p * F.log(p / base) + rest)).where(F.col("evidence") > math.log(max(1, tried)) + 1)
        # As the sample is bounded, so are the signs: each is in LEAST of its documents at least.
        signs = {r.f for r in strong.select("f").collect()}
        if not signs:
            by.unpersist()
            return Toxicity(costs, {}, base, base)
        # Special cases of the signs, which may be clean.
        known = docs.sparkSession.createDataFrame([(f,) for f in sorted(signs)], "b string")
        special = by.select("f", "n", "y", F.explode(broader(F.col("f"))).alias("b")).join(F.broadcast(known), "b").select("f", "n", "y").distinct()
        rows = special.collect()
        by.unpersist()
    finally:
        counted.unpersist()
    model = Toxicity(costs, {r.f: (r.n, r.y, r.f in signs) for r in rows}, base, 0.0)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Evidence(model)
        for b in slices(batches, "text"):
            e = [[round(STEPS * x) for x in seen.of(t)] for t in texts(b)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*e)), b.column(0).cast(pa.int64())], ["most", "rest", "y"])

    # As many rows as there are steps at most: 10 * 7 of the one, 10 * 30 of the other.
    steps = sample.mapInArrow(released(gathered), "most long, rest long, y long").groupBy("most", "rest").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    none = [sum(r[k] for r in steps if not r.most) for k in ("n", "y")]
    model.residual = (none[1] + base) / (none[0] + 1)
    model.line = logistic([(r.most / STEPS, r.rest / STEPS, r.n, r.y) for r in steps if r.most])
    return model


def logistic(rows: list[tuple[float, float, int, int]]) -> tuple[float, float, float]:
    """Intercept and slopes (not negative) fitted to (x1, x2, rows, positive rows), drawn towards (-2, 1, 0) as by a few rows.

    Newton steps, halved until the penalised likelihood (which is concave) rises.
    """
    start = np.array([-2.0, 1.0, 0.0])
    if not rows:
        return tuple(start.tolist())
    *xs, n, y = np.array(rows, float).T

    def fitted(free: list[int]) -> np.ndarray:
        x, prior = np.stack((np.ones_like(n), *xs), 1)[:, free], start[free]

        def worth(w: np.ndarray) -> float:
            z = x @ w
            return float((y * z - n * np.logaddexp(0, z)).sum() - ((w - prior) ** 2).sum() / 2)

        w = prior
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(free)), x.T @ (y - n * p) - (w - prior))
            while worth(w + step) < worth(w) and np.abs(step).max() > 1e-9:
                step = step / 2
            if np.abs(step).max() <= 1e-9:
                break
            w = w + step
        out = np.zeros(3)
        out[free] = w
        return out

    free = [0, 1, 2]
    while (w := fitted(free))[1:].min() < 0:
        free.remove(1 + int(w[1:].argmin()))
    return tuple(w.tolist())


def score(docs: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score double) per input row, 0 to 1; null and empty texts get the model's residual.

    Repeated rows have equal scores, null keys stay. Texts are whole however long, one at a time; an
    empty table gives no rows; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen = Evidence(m)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.probability(seen.of(t)) for t in texts(b)], pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(released(run), f"key {kind}, score double").withColumnRenamed("key", key)


def below(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold.

    Null and empty texts have the model's residual; repeated rows go or stay together; keys and other
    columns may hold anything and have any name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        seen = Evidence(m)
        for b in slices(batches, text):
            yield b.filter(pa.array([m.probability(seen.of(t)) < threshold for t in texts(b, text)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
