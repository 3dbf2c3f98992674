"""Near-duplicates by the resemblance (Jaccard similarity) of texts' shingle sets.

SimHash comes first: the fingerprints of the shingle sets are linked by Golay keys (see simhash), and
what has one fingerprint or linked ones is a candidate. A fingerprint of 64 bits cannot tell a
resemblance of 0.8 (about ten differing bits, often more) from chance in an index, so further
candidates come from BANDS groups of ROWS minima of the shingle hashes: two texts of resemblance 0.8
share none of the groups in about 3 of a million cases, and those of 0.9 practically never. Candidates
are then compared by their whole shingle sets, so that every link is true.

Equal sets are one node. Bands that hold the same nodes are looked at once. First every node of a
band is compared with the band's lowest node, as are the candidates by SimHash, and the links found give components; a band then
matters only if its other nodes lie in several of them, and only these nodes are compared further,
in blocks of bounded size that give spanning forests, never all pairs. So no task holds a band, and
nodes that are known to be connected are not compared again. Components are those of simhash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import released, slices, texts, use_checkpoints
from lodestone.llm.simhash import components, links, majority

SHINGLE = 5
#: Links have at least this resemblance, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 24, 4
#: Candidates up to this number are sent to all tasks; more are joined by a shuffle.
SENT = 200_000
#: Hashes of the sets that are compared in one block, and its least number of sets.
BLOCK, BLOCK_SETS = 100_000, 64

_SEEDS = np.random.default_rng(1).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles of a text's lower-cased words; fewer words are one shingle, none give none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in parts), np.uint64, len(words) - SHINGLE + 1))


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys (int64) of the bands of a set of hashes; an empty set has none."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[k : k + 2048, None] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def forest(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among nodes with these sets, breadth first."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    rest, edges = np.ones(len(sets), bool), []
    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start], queue = False, [start]
        while queue:
            node = queue.pop()
            if not rest.any():
                return edges
            left = rest[owner]
            flat, owner = flat[left], owner[left]
            mine = sets[node]
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            common = np.bincount(owner[mine[at] == flat], minlength=len(sets))
            near = np.flatnonzero(rest & (LEAST[1] * common >= LEAST[0] * (size + size[node] - common)))
            edges += [(nodes[node], nodes[k]) for k in near.tolist()]
            queue += near.tolist()
            rest[near] = False
    return edges


def _sketched(df: DataFrame) -> DataFrame:
    """(key, node long, fp long, size long, bands array<long>) of rows (key, text); fp is the SimHash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in slices(batches, "text"):
            sets = [shingles(t) for t in texts(b)]
            node = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            fp = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), pa.array(fp), pa.array([len(s) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["key", "node", "fp", "size", "bands"])

    return df.mapInArrow(released(run), f"key {df.schema['key'].dataType.simpleString()}, node long, fp long, size long, bands array<long>")


def _with_sets(df: DataFrame) -> DataFrame:
    """(node, hashes binary) of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in texts(b)], pa.binary())], ["node", "hashes"])

    return df.select("node", "text").mapInArrow(released(run), "node long, hashes binary")


def _alike(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, b, x binary, y binary) whose sets x and y are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(LEAST[1] * common >= LEAST[0] * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(released(run), "a long, b long")


def _linked(meeting: DataFrame) -> DataFrame:
    """(a, b) of the links among the nodes of each block; rows (block, node, hashes) come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, {}

        def out() -> pa.RecordBatch:
            found = forest(list(held), list(held.values())) if len(held) > 1 else []
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            for k, node, hashes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if k != block:
                    if len(held) > 1:
                        yield out()
                    block, held = k, {}
                held[node] = np.frombuffer(hashes.as_buffer(), np.uint64).copy()
        yield out()

    return meeting.mapInArrow(released(run), "a long, b long")


def _on(rows: DataFrame, one: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """rows joined with one, which has a row for each value of right. The join is dealt by other values
    than one was, so that both sides are plain shuffles and adaptive execution may split a hot value's rows."""
    return rows.join(one.withColumn("_on", F.bitwise_not(right)).drop(right), F.bitwise_not(left) == F.col("_on"), how).drop("_on")


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates among nodes (node, fp, size), those of one fingerprint and those whose fingerprints Golay keys link."""
    some = nodes.where("size > 0").select("node", "fp")
    first = some.groupBy("fp").agg(F.min("node").alias("first")).checkpoint()
    same = _on(some, first, "fp", "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    near = _on(_on(links(first), of("a"), "a", "a"), of("b"), "b", "b").select("a_node", "b_node")
    return same.union(near)


def _found(meeting: DataFrame, near: DataFrame, sets: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b): links that connect all that the links of near (a, b), and of the bands of nodes (band, node, size), connect."""
    leaders = meeting.groupBy("band").agg(F.min("node").alias("a"))
    pairs = _on(meeting, leaders, "band", "band").where("a <> node").select("a", F.col("node").alias("b")).union(near).distinct()
    held = _on(_on(pairs, sets.withColumnRenamed("hashes", "x"), "a", "node"), sets.withColumnRenamed("hashes", "y"), "b", "node")
    first = _alike(held).checkpoint()
    root = components(first, names).select(F.col("node").alias("of"), F.xxhash64(F.col("root")["node"]).alias("root"))
    others = _on(meeting, leaders, "band", "band").where("a <> node").drop("a")
    others = _on(others, root, "node", "of", "left").withColumn("root", F.coalesce("root", F.xxhash64("node"))).checkpoint()
    open_bands = others.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.sum("size").alias("hashes"), F.count("*").alias("sets"))
    parts = F.least(F.ceil(F.col("hashes") / BLOCK), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int")
    open_bands = open_bands.where("least <> most").select("band", parts.alias("n"))
    rest = _on(others, open_bands, "band", "band")
    # Every two of a band's n parts meet in one block; a band of one part is one block.
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")).cast("int")
    with_part = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.xxhash64("band", F.least(mine, k), F.greatest(mine, k)))
    blocks = rest.select("node", F.explode(with_part).alias("block"))
    held = _on(blocks, sets, "node", "node").select("block", "node", "hashes").repartition("block").sortWithinPartitions("block")
    return first.union(_linked(held)).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component) per input row: the lowest key that links of resemblance LEAST reach, itself included.

    Null and blank texts are alike. Keys must not be null and be of an orderable type; rows of one
    key must have one text. Repeated rows give repeated results. An empty table gives no rows. Texts
    are whole however long; other columns are not looked at.
    """
    use_checkpoints(df.sparkSession)
    plain = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = _sketched(plain).checkpoint()
    nodes = rows.groupBy("node").agg(F.min("key").alias("name"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands")).checkpoint()
    spread = nodes.select("node", "size", F.explode("bands").alias("band"))
    met = spread.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    once = met.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band")
    meeting = _on(spread, once.withColumn("met", F.col("band")), "band", "band").drop("met").checkpoint()
    near = _by_simhash(nodes).checkpoint()
    wanted = meeting.select("node").union(near.select("a")).union(near.select("b")).distinct().join(nodes, "node").select("node", F.col("name").alias("key")).checkpoint()
    few = wanted.count() <= SENT
    chosen = plain.join(F.broadcast(wanted) if few else wanted, "key")
    # One row a node: rows of one key have one text, but may be many.
    sets = _with_sets(chosen.groupBy("node").agg(F.first("text").alias("text"))).checkpoint()
    names = nodes.select("node", F.struct("name", "node").alias("name"))
    joined = components(_found(meeting, near, sets, names).checkpoint(), names).select("node", "root")
    named = nodes.join(joined, "node", "left").select("node", F.coalesce(F.col("root")["name"], F.col("name")).alias("component"))
    return _on(rows.select("key", "node"), named, "node", "node").select(F.col("key").alias(key), "component")
