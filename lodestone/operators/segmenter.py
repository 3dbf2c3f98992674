"""Words of text that is written without spaces: a dictionary learnt from a corpus, and the likeliest path through it.

learn() finds words by two statistics of the corpus: how much oftener a stretch of characters occurs than
its parts would by chance (cohesion), and how freely what stands on either side varies (branching
entropy). Equal runs are counted first, so that what is taken apart grows with the vocabulary and not
with the text. A run is then cut along the path of highest probability through the graph of dictionary
words; characters that no word covers are cut by a model of Begin, Middle, End and Single positions,
whose counts come from the runs that the dictionary has cut.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import use_checkpoints

#: Runs of characters that are segmented, in the syntax that Java and Python share; other words stay whole.
HAN = "[㐀-䶿一-鿿豈-﫿]+"
LETTERS = "[a-zà-öø-ÿß]+"
#: Longest word, least count, cohesion (natural log of the ratio) and entropy (nats).
LONGEST, MIN_COUNT, COHESION, ENTROPY = 4, 5, 2.0, 0.7
#: Most words of a dictionary that tasks hold.
MOST_WORDS = 500_000
STATES = "BMES"
#: Which position may follow which.
FOLLOWS = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


def runs(texts: DataFrame, text: str = "text", pattern: str = HAN) -> DataFrame:
    """(run string, n long): the distinct lower-case runs of a pattern and how often they occur. Null texts have none."""
    found = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0)))
    return texts.select(found.alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def stretches(counted: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(word, size int, before, after string, n long): all stretches of up to longest characters with the character on
    either side, empty at the end of a run."""
    rows = counted.select(F.split("run", "").alias("c"), "n")
    rows = rows.select("c", "n", F.posexplode("c").alias("i", "_")).select("c", "n", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("c") - F.col("i")))).alias("size"))
    side = lambda at: F.coalesce(F.when(at >= 0, F.get("c", at)), F.lit(""))
    each = rows.select(F.array_join(F.slice("c", F.col("i") + 1, F.col("size")), "").alias("word"), "size", side(F.col("i") - 1).alias("before"), side(F.col("i") + F.col("size")).alias("after"), "n")
    return each.groupBy("word", "size", "before", "after").agg(F.sum("n").alias("n"))


def _entropy(parts: DataFrame, side: str) -> DataFrame:
    """(word, side double): entropy of one side's characters."""
    n = parts.groupBy("word", side).agg(F.sum("n").cast("double").alias("n"))
    return n.groupBy("word").agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias(side))


def learn(counted: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, cohesion: float = COHESION, entropy: float = ENTROPY) -> DataFrame:
    """(word, size int, freq long, cohesion, left, right double): the words that a table of runs suggests.

    cohesion is the least, over all ways to cut a word in two, of ln(freq * total / (freq of both parts)), and
    null for single characters; left and right are entropies. A word has at least the given count, cohesion and
    entropies. An empty table gives no words.
    """
    use_checkpoints(counted.sparkSession)
    parts = stretches(counted, longest).checkpoint()  # read by every statistic
    freq = parts.groupBy("word", "size").agg(F.sum("n").alias("freq")).where(F.col("freq") >= min_count)
    total = freq.where("size = 1").agg(F.sum("freq").alias("total"))
    cuts = freq.where("size > 1").select("word", "freq", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("word", "freq", F.substring(F.col("word"), F.lit(1), F.col("k")).alias("a"), F.substring(F.col("word"), F.col("k") + 1, F.col("size") - F.col("k")).alias("b"))
    part = lambda c: freq.select(F.col("word").alias(c), F.col("freq").alias(f"{c}_freq"))
    ratio = F.log(F.col("freq") * F.col("total") / F.col("a_freq") / F.col("b_freq"))
    tied = cuts.join(part("a"), "a").join(part("b"), "b").crossJoin(F.broadcast(total)).groupBy("word").agg(F.min(ratio).alias("cohesion"))  # total is one row
    known = freq.join(tied, "word", "left").join(_entropy(parts, "before"), "word").join(_entropy(parts, "after"), "word").withColumnsRenamed({"before": "left", "after": "right"})
    tight = (F.col("size") == 1) | (F.col("cohesion") >= cohesion)
    return known.where(tight & (F.least("left", "right") >= entropy))


@dataclass
class Segmenter:
    """A dictionary word -> natural log of its probability, and the model for what it does not cover.

    start, move and emit are logs of probabilities by position, pair of positions, and position and
    character; a model without counts cuts unknown characters one by one.
    """

    words: dict[str, float]
    unknown: float
    pattern: str = HAN
    start: dict[str, float] = field(default_factory=dict)
    move: dict[str, float] = field(default_factory=dict)
    emit: dict[str, dict[str, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.words), default=1)

    def path(self, run: str) -> list[str]:
        """The words of highest total log probability that make up run; longer first words on ties.

        A character is a word of itself if nothing else is known of it.
        """
        best, to = [0.0] * (len(run) + 1), [0] * len(run)
        for i in range(len(run) - 1, -1, -1):
            best[i] = -math.inf
            for j in range(i + 1, min(len(run), i + self.longest) + 1):
                p = self.words.get(run[i:j], self.unknown if j == i + 1 else None)
                if p is not None and p + best[j] >= best[i]:
                    best[i], to[i] = p + best[j], j
        out, at = [], 0
        while at < len(run):
            out.append(run[at : to[at]])
            at = to[at]
        return out

    def positions(self, chars: str) -> str:
        """The likeliest positions (Viterbi) of characters that no word covers."""
        if not self.start:
            return "S" * len(chars)
        floor = min(self.emit["S"].values(), default=-20.0) - 1
        of = lambda s, c: self.emit[s].get(c, floor)
        score = {s: self.start[s] + of(s, chars[0]) for s in "BS"}
        back = []
        for c in chars[1:]:
            came = {t: max((s for s in score if t in FOLLOWS[s]), key=lambda s: score[s] + self.move[s + t]) for t in STATES if any(t in FOLLOWS[s] for s in score)}
            score = {t: score[s] + self.move[s + t] + of(t, c) for t, s in came.items()}
            back.append(came)
        state = max((s for s in score if s in "ES"), key=score.__getitem__)
        out = [state]
        for came in reversed(back):
            state = came[state]
            out.append(state)
        return "".join(reversed(out))

    def cut(self, run: str) -> list[str]:
        """The words of a run."""
        return self.closed(self.path(run))

    def closed(self, path: list[str]) -> list[str]:
        """The words of a path, whose characters that no word covers are joined by their positions."""
        out, open_chars = [], ""
        for w in [*path, ""]:
            if len(w) == 1 and w not in self.words:
                open_chars += w
                continue
            for c, s in zip(open_chars, self.positions(open_chars) if open_chars else "", strict=True):
                if s in "BS":
                    out.append(c)
                else:
                    out[-1] += c
            open_chars = ""
            out += [w] * bool(w)
        return out

    def __call__(self, text: Column) -> Column:
        """array<string>: the lower-case words of a text; runs of the pattern are cut, other letters and digits stay
        together, the rest is dropped. A null text has none. To be given as a tokenizer."""
        known = self

        @F.pandas_udf("array<string>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            find, own = re.compile(f"{known.pattern}|[^\\W_]+").finditer, re.compile(known.pattern).fullmatch
            split = re.compile(f"({known.pattern})").split
            for b in batches:
                yield pd.Series([[w for m in find((t or "").lower()) for x in split(m[0]) if x for w in (known.cut(x) if own(x) else [x])] for t in b], dtype=object)

        return run(text)


def fitted(counted: DataFrame, dictionary: DataFrame, pattern: str = HAN) -> Segmenter:
    """A segmenter of the dictionary (word, freq), of which the most frequent MOST_WORDS are taken (ties to the lower word).

    The position model is counted over the runs as the dictionary cuts them, with add-one smoothing of moves. What comes to
    the driver is the dictionary, and counts by character, whose number the script bounds.
    """
    return _fitted(counted, dictionary, pattern)[0]


def fitted_cut(counted: DataFrame, dictionary: DataFrame, pattern: str = HAN) -> DataFrame:
    """cut_runs() of the runs that a segmenter is fitted to, whose paths through the dictionary are found only once."""
    known, pieces = _fitted(counted, dictionary, pattern)
    return _cut(pieces, F.col("pieces"), known, lambda s, x: s.closed(x))


def _fitted(counted: DataFrame, dictionary: DataFrame, pattern: str) -> tuple[Segmenter, DataFrame]:
    """The segmenter, and (run, n, pieces) as the dictionary alone cuts the runs."""
    use_checkpoints(counted.sparkSession)
    rows = dictionary.select("word", "freq").orderBy(F.desc("freq"), "word").limit(MOST_WORDS).collect()
    total = sum(r.freq for r in rows) + 1
    first = Segmenter({r.word: math.log(r.freq / total) for r in rows}, math.log(0.5 / total), pattern)
    pieces = cut_runs(counted, first).checkpoint()
    at = F.transform("pieces", lambda w: F.when(F.length(w) == 1, F.lit("S")).otherwise(F.concat(F.lit("B"), F.repeat(F.lit("M"), F.length(w) - 2), F.lit("E"))))
    placed = pieces.select("n", F.split(F.array_join("pieces", ""), "").alias("c"), F.split(F.array_join(at, ""), "").alias("s"))
    each = placed.select("n", F.posexplode(F.arrays_zip("c", "s", F.concat(F.array(F.lit("")), "s").alias("p"))).alias("i", "x"))
    counts = each.where("x.s is not null").groupBy(F.col("x.c").alias("c"), F.col("x.s").alias("s"), F.col("x.p").alias("p")).agg(F.sum("n").alias("n")).collect()
    move, emit, start = {s + t: 1 for s in STATES for t in FOLLOWS[s]}, {s: {} for s in STATES}, {"B": 1, "S": 1}
    for r in counts:
        emit[r.s][r.c] = emit[r.s].get(r.c, 0) + r.n
        if r.p:
            move[r.p + r.s] += r.n
        else:
            start[r.s] += r.n
    if not counts:
        return first, pieces
    logs = lambda d, n: {k: math.log(v / n) for k, v in d.items()}
    known = Segmenter(first.words, first.unknown, pattern, logs(start, sum(start.values())), {}, {s: logs(x, sum(x.values()) + len(x) + 1) for s, x in emit.items()})
    known.move = {s + t: math.log(move[s + t] / sum(move[s + u] for u in FOLLOWS[s])) for s in STATES for t in FOLLOWS[s]}
    return known, pieces


def cut_runs(counted: DataFrame, segmenter: Segmenter) -> DataFrame:
    """(run, n, pieces array<string>): each distinct run cut once."""
    return _cut(counted, F.col("run"), segmenter, lambda s, x: s.cut(x))


def _cut(counted: DataFrame, column: Column, segmenter: Segmenter, how: Callable[[Segmenter, str | list[str]], list[str]]) -> DataFrame:
    known = counted.sparkSession.sparkContext.broadcast(segmenter)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([how(known.value, x) for x in b], dtype=object)

    return counted.select("run", "n", cut(column).alias("pieces"))
