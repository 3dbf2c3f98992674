"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits, each read as a word of
the perfect binary Golay code (23, 12, 7). A segment's fuzzy keys are the codeword next to it and,
where that is three errors away, the five codewords at distance four: two segments that differ in
at most two bits always share a key. Two fingerprints that differ in at most four bits have either
one segment without errors and another with at most two (first family of keys: a whole segment and
a fuzzy key of another), or errors in all three, of which two have just one (second family: a half
of each of these two is whole, and the third segment shares a fuzzy key). So every link shares a
key, and a key spans 31 to 34 bits, so that unrelated fingerprints seldom meet.

Equal fingerprints are one node. The members of a key are verified where they lie, in sorted runs:
a run gives a spanning forest of its links, never all pairs. Components come from rounds of
hooking to the lowest neighbour and jumping, each written by checkpoint().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import released, slices, texts, use_checkpoints

#: Links have at most so many differing bits; the key families are built for this number.
MAX_BITS = 4
SHINGLE = 4
#: Edges for each task of a round of components.
TASK_EDGES = 20_000
#: Bit ranges of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The Golay code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def syndromes_of(words: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit words by the generator."""
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(errors [2048, 6] by syndrome, their number): the error patterns of a syndrome's fuzzy keys."""
    single = syndromes_of(1 << np.arange(23))
    patterns = [np.array([sum(1 << b for b in c) for c in combinations(range(23), w)], np.int64) for w in range(5)]
    found = [np.array([np.bitwise_xor.reduce(single[list(c)]) if c else 0 for c in combinations(range(23), w)], np.int64) for w in range(5)]
    leader = np.zeros(2048, np.int64)
    for p, s in zip(patterns[:4], found[:4], strict=True):
        leader[s] = p
    errors, n = np.repeat(leader[:, None], 6, 1), np.ones(2048, np.int64)
    order = np.argsort(found[4], kind="stable")
    four, at = patterns[4][order], found[4][order]
    far = popcount(leader) == 3
    errors[at[far[at]][::5], 1:] = four[far[at]].reshape(-1, 5)
    n[far] = 6
    return errors, n


@cache
def syndromes() -> np.ndarray:
    """The syndrome of every 23-bit word, by its high 12 and low 11 bits (the code is linear)."""
    return syndromes_of(np.arange(1 << 12) << 11)


def fuzzy(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys [n, 6], number that count): codeword indices (the 12 information bits) near each segment."""
    errors, n = golay()
    s = syndromes()[segment >> 11] ^ (segment & 2047)
    return (segment[:, None] ^ errors[s]) >> 11, n[s]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) of all keys of distinct fingerprints (uint64)."""
    seg = [(prints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [fuzzy(s) for s in seg]
    half = [(s >> 11, s & 2047) for s in seg]
    column = np.arange(6)
    rows, out, family = [], [], 0

    def add(fixed: np.ndarray, k: int) -> None:
        nonlocal family
        codes, n = near[k]
        at, j = np.nonzero(column < n[:, None])
        rows.append(at)
        out.append(((family << 24 | fixed[at]) << 12 | codes[at, j]).astype(np.int64))
        family += 1

    for i in range(3):
        for k in range(3):
            if i != k:
                add(seg[i], k)
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        for a in half[i]:
            for b in half[j]:
                add(a << 11 | b, k)
    return np.concatenate(rows), np.concatenate(out)


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints.

    Breadth first: each node takes what is near it out of those not yet reached, so that dense
    groups are used up in a few steps.
    """
    rest, edges = prints, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = popcount(rest ^ node) <= MAX_BITS
            if near.any():
                found = rest[near]
                edges += [(int(node), int(x)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; none without hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(words: list[bytes]) -> int:
    """The SimHash of a text's lower-cased words: majority of the bits of XXH64 (seed 42) of all shingles."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), 42)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return majority(np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(words) - SHINGLE + 1))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) per input row; null and blank texts have 0. The long holds the unsigned bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t.encode().lower().split()) for t in texts(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(released(run), f"key {kind}, fp long").withColumnRenamed("key", key)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) for distinct fingerprints (fp): links that join every two nodes whose bits differ in at
    most MAX_BITS places to one component. Every row is a true link."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 20_000) for k in range(0, b.num_rows, 20_000)):
                fps = part.column(0).to_numpy(zero_copy_only=False)
                at, key = keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[at])], ["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by key; a run that goes on in the next batch is carried over."""
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def pairs(key, fp, last):
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(first[1:], len(key))
            cut = len(key) if last else int(first[-1])
            edges = []
            size = ends - first
            two = first[(size == 2) & (ends <= cut)]
            ok = two[popcount(fp[two] ^ fp[two + 1]) <= MAX_BITS]
            edges.append(np.stack((fp[ok], fp[ok + 1]), 1))
            for k in np.flatnonzero((size > 2) & (ends <= cut)).tolist():
                if found := forest(fp[first[k] : ends[k]]):
                    edges.append(np.array(found, np.uint64))
            e = np.concatenate(edges)
            return cut, pa.RecordBatch.from_arrays([pa.array(e[:, 0].view(np.int64)), pa.array(e[:, 1].view(np.int64))], ["a", "b"])

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([k for k, _ in waiting]), np.ascontiguousarray(np.concatenate([f for _, f in waiting]))

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy(zero_copy_only=False)
            waiting.append((key, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if waiting[0][0][0] == key[-1]:
                continue
            held_key, held = joined()
            cut, out = pairs(held_key, held, False)
            waiting = [(held_key[cut:], held[cut:])]
            yield out
        if waiting:
            yield pairs(*joined(), True)[1]

    spread_out = nodes.select("fp").mapInArrow(spread, "key long, fp long")
    return spread_out.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the lowest name of its component.

    names (node, name) names every node differently; roots are names. Each round takes the lowest root around
    each node, gives it to the node's former root as well, and follows roots once more; it ends
    when no root changes. Rows per round are those of the edges, and so are the tasks that write them, as many
    small files would take more room than what they hold.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a")).distinct().checkpoint()
    few = 4 + both.count() // TASK_EDGES
    both = both.coalesce(few)
    roots = both.select("node").distinct().join(names, "node").select("node", F.col("name").alias("own"), F.col("name").alias("root")).coalesce(few).checkpoint()
    while True:
        around = both.join(roots.select(F.col("node").alias("to"), F.col("root").alias("near")), "to").coalesce(few).groupBy("node").agg(F.min("near").alias("near"))
        hooked = roots.join(around, "node").coalesce(few).withColumn("new", F.least("root", "near"))
        # A node that a root names learns the lowest root that any of its followers has found.
        told = hooked.groupBy(F.col("root").alias("own")).agg(F.min("new").alias("told"))
        step = hooked.join(told, "own", "left").select("node", "own", "root", F.least("new", F.coalesce("told", "new")).alias("new")).coalesce(few)
        # A popular root is looked up by many rows: dealt by other values than the names, both sides
        # are plain shuffles, and adaptive execution may split its rows.
        jump = step.select(F.struct("own").alias("at"), F.col("new").alias("far"))
        fresh = step.join(jump, F.struct(F.col("new").alias("own")) == F.col("at"), "left").select("node", "own", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")).coalesce(few).checkpoint()
        moved = fresh.where("root <> old").limit(1).count()
        roots = fresh.drop("old")
        if not moved:
            return roots.select("node", "root")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", by: str = "bits") -> DataFrame:
    """(key, fp long, component) per input row: the lowest key that links reach, itself included.

    Null and blank texts have fingerprint zero and are linked like any other. Keys must be of an
    orderable type; a null key has no say in a component's name unless all of it are null.
    Repeated rows give repeated results. An empty table gives no rows. Texts are whole however long,
    and other columns are not looked at.

    by="shingles" links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
    more. Fingerprints of these sets that Golay keys link are candidates, verified by the whole sets; a
    similarity of 0.8 is often more than ten bits, which such keys do not tell from chance, and resemblance
    adds what they miss. Gives (key, component). Keys must not be null then.
    """
    if by not in ("bits", "shingles"):
        raise ValueError("by is bits or shingles")
    if by == "shingles":
        from lodestone.llm import resemblance

        return resemblance.near_duplicates(df, key, text)
    use_checkpoints(df.sparkSession)
    rows = fingerprints(df, key, text).withColumnRenamed(key, "key").checkpoint()
    # Null keys come last, and the fingerprint keeps names apart where rows of different texts share a key.
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "fp")).alias("name")).checkpoint()
    found = links(nodes).checkpoint()
    joined = components(found, nodes.select(F.col("fp").alias("node"), "name"))
    named = nodes.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "name")["key"].alias("component"))
    # Dealt by other values than the nodes are, so that both sides are plain shuffles and adaptive
    # execution may split the rows of a hot fingerprint.
    named = named.select(F.bitwise_not("fp").alias("not_fp"), "component")
    return rows.join(named, F.bitwise_not("fp") == F.col("not_fp")).select(F.col("key").alias(key), "fp", "component")
