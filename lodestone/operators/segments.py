"""A BM25 index that is stored, grows by segments, and is searched without tokenising the corpus.

A batch of documents becomes one immutable segment: a forward table (a row for each document with
its distinct terms) and posting blocks. A block is what one term has in one group of some hundred
documents, with the highest count and the least length in it, which bound every score the block can give.
The blocks of a group lie packed in a row for each bucket of terms, so that rows follow groups and not postings.
A manifest names the live segments; deleted documents are tombstones until a compaction.

A search takes the blocks of its terms, group by group. The bounds of a group's blocks, weighted for
every query at once, say what the best document in it could reach. Groups that can reach most are scored
first and give each query a threshold, its k-th best score so far; of all other groups only those are
read that reach the threshold of a query, and only for such queries. A group's scores are one matrix
product of query weights and postings. The ranking is exactly that of bm25.scores().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.text import tokens
from lodestone.operators.bm25 import B, K1, SENT_IDS, Tokenizer, top
from lodestone.sources import manifest
from lodestone.sources.shared import use_checkpoints

#: Mean documents of a full group (a block has at most about so many postings), words of one if its documents are long, and
#: mean groups that one task makes blocks of, a file for each bucket.
GROUP_DOCS, GROUP_WORDS, TASK_GROUPS = 256, 131_072, 32
#: Documents that a Python worker gets at once while it makes a segment: about a group, since documents of one kind may all be long.
BATCH_DOCS = 256
#: Rows of packed blocks, or groups, that a Python worker gets at once in a search: a megabyte each at most, about.
BATCH_GROUPS = 32
#: Documents lie together by their most frequent word, hashed to so many kinds at most and one for so many documents, and by
#: powers of two of their length: a group then speaks one language and its bounds are near its scores.
MOST_KINDS, KIND_DOCS = 64, 1024
#: Terms lie in folders by hash, so that a search opens those of its terms alone.
BUCKETS = 8
#: Scores are compared by bounds with this margin, since they are ranked as rounded to 6 digits.
MARGIN = 2e-6
#: Terms of queries that tasks hold at once (other queries follow in further passes), and queries of a matrix product.
SENT_TERMS, QUERY_BLOCK = 1_000_000, 512
#: Groups that are scored first for each query.
FIRST_GROUPS = 2
#: Candidates that a task of a search holds beside k for each query.
HELD = 200_000
#: Bytes of UTF-8 that are white space.
SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What a row of packed blocks has, as int32 but for the terms (UTF-8, joined) and doc_ids (int64): of each term its bytes, postings
#: and what bounds these; the group's documents; and of each posting, term by term, the document's place among these and the count.
PACKED = {c: np.int64 if c == "doc_ids" else np.int32 for c in ("sizes", "n", "max_tf", "min_len", "doc_ids", "lens", "at", "tfs")}
PACK = "g int, terms binary, " + ", ".join(f"{c} binary" for c in PACKED)
#: The blocks of a group's wanted terms; t is a term's place among these.
HEAD = {c: pa.list_(pa.int32()) for c in ("t", "n", "max_tf", "min_len")}
CHOSEN = {**HEAD, "at": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32())}


@contextmanager
def _batches_of(spark: SparkSession, n: int):
    """Python workers get n rows at once in what runs meanwhile."""
    before = spark.conf.get(PER_BATCH)
    spark.conf.set(PER_BATCH, str(n))
    try:
        yield
    finally:
        spark.conf.set(PER_BATCH, before)


def _coded(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct terms in order, and the place of each term among them."""
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words between white space of texts without nulls, as tokens() has them of lower-cased ones, and how many each text has."""
    cuts = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
    cuts = cuts - cuts[0]
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(cuts))  # a word ends with its text
    begins[cuts[full]], ends[cuts[full + 1] - 1] = inside[cuts[full]], inside[cuts[full + 1] - 1]
    at = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - at
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.py_buffer(data[inside]))
    return words, np.diff(np.searchsorted(at, cuts))


def _distinct(words: pa.Array, own: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of words, each of text own among n: the distinct ones in order; and for each text the places of its own among these, in order, the
    counts, and where the texts are cut."""
    terms, code = _coded(words)
    both, tf = np.unique(own * max(1, len(terms)) + code, return_counts=True)
    own, code = np.divmod(both, max(1, len(terms)))
    return terms, code, tf, np.searchsorted(own, np.arange(n + 1))


def term_counts(words: Column) -> Column:
    """array<struct<term, tf int>> of an array of tokens, by term; without explode or shuffle."""

    @F.arrow_udf("array<struct<term:string,tf:int>>")
    def run(w: pa.Array) -> pa.Array:
        terms, code, n, cuts = _distinct(w.flatten(), pc.list_parent_indices(w).to_numpy().astype(np.int64), len(w))
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([terms.take(pa.array(code)), pa.array(n, pa.int32())], ["term", "tf"]))

    return run(words)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, len, often, terms, tfs) of rows (doc_id, lower-cased text without nulls, or array of tokens)."""
    for b in batches:
        of = b.column(1)
        if not len(of):
            continue
        words, sizes = (of.flatten().cast(pa.string()), of.value_lengths().fill_null(0).to_numpy()) if pa.types.is_list(of.type) else _split(of.cast(pa.string()))
        terms, code, tf, cuts = _distinct(words, np.repeat(np.arange(len(of)), sizes), len(of))
        full = np.flatnonzero(np.diff(cuts))
        often = np.zeros(len(of), np.int64)
        often[full] = np.maximum.reduceat(tf * len(terms) + code, cuts[full]) % len(terms) if len(full) else 0
        ends = pa.array(cuts, pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (terms.take(pa.array(code)), pa.array(tf, pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), terms.take(pa.array(often, mask=sizes == 0)), *lists], ["doc_id", "len", "often", "terms", "tfs"])


class Bm25Index:
    """The index below a folder that all executors share. Ids are longs, each of one live document."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: Tokenizer = tokens, k1: float = K1, b: float = B):
        self.spark, self.folder, self.tokenizer, self.k1, self.b = spark, folder, tokenizer, k1, b

    # -- what is stored

    def _state(self) -> tuple[int, dict]:
        version, body = manifest.read(self.spark, self.folder)
        return version, body or {"segments": {}, "deleted": {}, "retired": []}

    def _rows(self, kind: str, segments) -> DataFrame:
        """A table of all segments, with segment as a column."""
        schema = {
            "forward": "doc_id long, len int, kind int, terms array<string>, tfs array<int>",
            "groups": "kind int, start int, n_groups int",
            "packs": f"bucket int, {PACK}",
            "deleted": "segment string, g int, doc_id long, len int, terms array<string>",
        }[kind]
        names = sorted(segments)
        if not names:
            return self.spark.createDataFrame([], schema + (", segment string" if kind != "deleted" else ""))
        read = self.spark.read.schema(schema)
        if kind == "deleted":
            return read.parquet(*(f"{self.folder}/deleted/{x}" for x in names))
        # segment= is a partition of the folder, so that one scan has them all.
        paths = [f"{self.folder}/{kind}/segment={x}" for x in names]
        return self.spark.read.schema(f"{schema}, segment string").option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def __len__(self) -> int:
        """Live documents, by the manifest alone."""
        _, body = self._state()
        return sum(s["docs"] for s in body["segments"].values()) - sum(d["docs"] for d in body["deleted"].values())

    def segments(self) -> dict:
        """The live segments: documents, tokens and postings of each."""
        return self._state()[1]["segments"]

    def documents(self) -> DataFrame:
        """(doc_id, len int) of the live documents."""
        _, body = self._state()
        return self._live(body).select("doc_id", "len")

    def _live(self, body: dict) -> DataFrame:
        return self._rows("forward", body["segments"]).join(self._rows("deleted", body["deleted"]).select("segment", "doc_id"), ["segment", "doc_id"], "left_anti")

    # -- changes

    def add(self, docs: DataFrame, name: str | None = None) -> bool:
        """Append (doc_id, text) as a segment; False, and no change, if a segment of that name was added before.

        A batch that runs again under its name thus changes nothing, whether it had been published or
        not. A null text has no tokens. Ids that are null, repeated or live already raise ValueError before
        anything is published. An empty batch adds an empty segment. Other columns are not read.
        """
        name = name or uuid.uuid4().hex
        version, body = self._state()
        if name in body["segments"] or name in body["retired"]:
            return False
        n = docs.count()
        # Words between white space are cut in the worker, since an array of tokens takes far longer to get there than its text.
        words = F.lower(F.coalesce("text", F.lit(""))) if self.tokenizer is tokens else self.tokenizer(F.col("text"))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
        self._write_forward(rows.mapInArrow(_documents, "doc_id long, len int, often string, terms array<string>, tfs array<int>"), n, name)
        counts = self._counts(name)
        if counts.pop("nulls") or counts.pop("ids") != n:
            raise ValueError("document ids are null or repeated")
        fresh = self._rows("forward", [name]).select("doc_id")
        if self._live(body).join(fresh, "doc_id", "left_semi").limit(1).count():
            raise ValueError("some of the documents are in the index")
        self._write_blocks(name)
        body["segments"][name] = counts
        manifest.publish(self.spark, self.folder, version, body)
        return True

    def _write_forward(self, rows: DataFrame, n: int, name: str) -> None:
        """The forward table of (doc_id, len, often: the most frequent term, of several the last, terms, tfs), and how each kind of document is
        cut in groups."""
        kinds = min(MOST_KINDS, 1 + n // KIND_DOCS)
        kind = F.pmod(F.xxhash64("often"), F.lit(kinds)) * 32 + F.floor(F.log2(F.col("len") + 1))
        with _batches_of(rows.sparkSession, BATCH_DOCS):  # a stream's batches have a session of their own
            rows.select("doc_id", "len", kind.cast("int").alias("kind"), "terms", "tfs").write.mode("overwrite").parquet(f"{self.folder}/forward/segment={name}")
        sizes = self._rows("forward", [name]).groupBy("kind").count().collect()  # 32 * MOST_KINDS at most
        start, groups = 0, []
        for r in sorted(sizes):
            docs = max(1, min(GROUP_DOCS, GROUP_WORDS >> (r.kind % 32)))
            groups.append((r.kind, start, -(-r["count"] // docs)))
            start += groups[-1][2]
        self.spark.createDataFrame(groups, "kind int, start int, n_groups int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/groups/segment={name}")

    def _grouped(self, segments) -> DataFrame:
        """The forward table with g, the document's group in its segment."""
        g = F.col("start") + F.pmod(F.xxhash64("doc_id"), F.col("n_groups"))
        return self._rows("forward", segments).join(F.broadcast(self._rows("groups", segments)), ["segment", "kind"]).withColumn("g", g.cast("int"))

    def _counts(self, name: str) -> dict:
        rows = self._rows("forward", [name])
        r = rows.agg(
            F.count("*").alias("docs"),
            F.count_distinct("doc_id").alias("ids"),
            F.count_if(F.col("doc_id").isNull()).alias("nulls"),
            F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"),
            F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings"),
        )
        return r.collect()[0].asDict()

    def _write_blocks(self, name: str) -> None:
        """Blocks of a segment. Documents are dealt out by group, so that what one term has in all documents is spread as well."""
        groups = self._rows("groups", [name]).agg(F.coalesce(F.sum("n_groups"), F.lit(1))).collect()[0][0]
        # A document's terms travel as one string and their lengths.
        joined, sizes = F.encode(F.array_join("terms", ""), "UTF-8"), F.transform("terms", lambda x: F.octet_length(x))
        dealt = self._grouped([name]).select("doc_id", "len", "g", joined.alias("joined"), sizes.alias("sizes"), "tfs").repartition(-(-groups // TASK_GROUPS), "g").sortWithinPartitions("g")
        packs = dealt.mapInArrow(_blocks, f"bucket int, {PACK}")
        with _batches_of(self.spark, BATCH_DOCS):
            packs.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/packs/segment={name}")

    def delete(self, ids: DataFrame, name: str | None = None) -> int:
        """Take documents (doc_id) out; ids that are not live are ignored. Returns how many went.

        A deletion that runs again under its name changes nothing. Statistics of what went are kept
        with the tombstones, so that later searches rank as if it had never been there.
        """
        name = name or uuid.uuid4().hex
        version, body = self._state()
        if name in body["deleted"] or name in body["retired"]:
            return 0
        use_checkpoints(self.spark)
        there = self._live(body).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("segment", "doc_id").checkpoint()
        few = there.count() <= SENT_IDS  # then terms stay where they are read
        gone = self._grouped(body["segments"]).join(F.broadcast(there) if few else there, ["segment", "doc_id"], "left_semi")
        gone.select("segment", "g", "doc_id", "len", "terms").write.mode("overwrite").parquet(f"{self.folder}/deleted/{name}")
        r = self._rows("deleted", [name]).agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).collect()[0]
        body["deleted"][name] = r.asDict()
        manifest.publish(self.spark, self.folder, version, body)
        return r.docs

    def compact(self) -> None:
        """Rewrite the live documents as one segment without tombstones. Readers of earlier versions are not disturbed;
        vacuum() then deletes what only those name."""
        version, body = self._state()
        name = f"compact-{version + 1}"
        docs = sum(s["docs"] for s in body["segments"].values()) - sum(d["docs"] for d in body["deleted"].values())
        often = F.array_max(F.arrays_zip("tfs", "terms"))["terms"]
        self._write_forward(self._live(body).select("doc_id", "len", often.alias("often"), "terms", "tfs"), docs, name)
        counts = {k: v for k, v in self._counts(name).items() if k in ("docs", "tokens", "postings")}
        self._write_blocks(name)
        retired = [*body["retired"], *body["segments"], *body["deleted"]]
        manifest.publish(self.spark, self.folder, version, {"segments": {name: counts}, "deleted": {}, "retired": retired})

    def vacuum(self) -> None:
        """Delete the tables of retired segments and tombstones."""
        for x in self._state()[1]["retired"]:
            for path in (f"forward/segment={x}", f"groups/segment={x}", f"packs/segment={x}", f"deleted/{x}"):
                manifest.delete(self.spark, f"{self.folder}/{path}")

    # -- search

    def search(self, queries: DataFrame, k: int, delete_mode: str = "exact") -> DataFrame:
        """(query_id, doc_id, score double, rank long): the k best live documents of each (query_id, text).

        Scores, ties and delete_mode are those of bm25.scores(); a repeated query term counts again, and
        queries without a known term, or k <= 0, have no rows.
        """
        return top(self._search(queries, k, delete_mode)[0], k)

    def reads(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, n_blocks, n_read long): the blocks of each query's terms, and those that its threshold lets through."""
        return self._search(queries, k, "exact", only_reads=True)[1]

    def _search(self, queries: DataFrame, k: int, delete_mode: str, only_reads: bool = False) -> tuple[DataFrame, DataFrame]:
        """Candidates (none if only reads are asked for) and reads."""
        if delete_mode not in ("exact", "reference"):
            raise ValueError("delete_mode is exact or reference")
        use_checkpoints(self.spark)
        _, body = self._state()
        kind = queries.schema["query_id"].dataType
        hits = self.spark.createDataFrame([], f"query_id {kind.simpleString()}, doc_id long, score double")
        counts = self.spark.createDataFrame([], f"query_id {kind.simpleString()}, n_blocks long, n_read long")
        if not body["segments"] or k <= 0:
            return hits, counts
        asked = queries.select("query_id", F.explode(self.tokenizer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")).checkpoint()
        passes = -(-asked.count() // SENT_TERMS)
        for i in range(passes):
            some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) if passes > 1 else asked
            with _batches_of(self.spark, BATCH_GROUPS):
                found, read = self._pass(some, body, k, delete_mode == "exact", kind, only_reads)
            hits, counts = hits.union(found) if found else hits, counts.union(read) if read else counts
        return hits, counts

    def _weights(self, df: np.ndarray, body: dict, exact: bool, wanted: Broadcast) -> tuple[np.ndarray, float]:
        """What a query gets for one occurrence of each wanted term, which df documents have, and the mean length."""
        all_docs, all_tokens = (sum(s[x] for s in body["segments"].values()) for x in ("docs", "tokens"))
        gone_docs, gone_tokens = (sum(d[x] for d in body["deleted"].values()) for x in ("docs", "tokens"))
        if body["deleted"] and exact:
            df = df - _sums(self._rows("deleted", body["deleted"]).select("terms").mapInArrow(_occur(wanted), "t int, n long"), len(df))
        length = (all_tokens - gone_tokens * exact) / max(1, all_docs - gone_docs * exact)
        return np.log((all_docs - gone_docs - df + 0.5) / (df + 0.5) + 1), length or 1.0

    def _pass(self, some: DataFrame, body: dict, k: int, exact: bool, kind, only_reads: bool) -> tuple[DataFrame | None, DataFrame | None]:
        """Candidates and reads of some queries, whose terms every task holds; None if the index has none of these."""
        rows = some.collect()  # SENT_TERMS at most, about
        terms = sorted({r.term for r in rows})
        wanted = self.spark.sparkContext.broadcast(terms)
        packs = self._rows("packs", body["segments"]).where(F.col("bucket").isin(sorted({_bucket(x.encode()) for x in terms})))
        ints = lambda columns: ", ".join(f"{c} array<int>" for c in columns)
        parts = packs.select("segment", "g", "terms", "sizes", "n", "max_tf", "min_len").mapInArrow(_wanted(wanted, HEAD), f"segment string, g int, {ints(HEAD)}")
        parts = parts.groupBy("segment", "g").agg(F.collect_list(F.struct(*HEAD)).alias("x"))
        heads = parts.select("segment", "g", *(F.flatten(f"x.{c}").alias(c) for c in HEAD)).checkpoint()
        df = _sums(heads.select("t", "n").mapInArrow(_postings(len(terms)), "t int, n long"), len(terms))
        of_term = {x: i for i, x in enumerate(terms)}
        rows = [r for r in rows if df[of_term[r.term]]]
        if not rows:
            return None, None
        weight, length = self._weights(df, body, exact, wanted)
        ids = sorted({r.query_id for r in rows}, key=lambda x: (x is None, x))
        of_id = {x: i for i, x in enumerate(ids)}
        q, t = np.array([of_id[r.query_id] for r in rows], np.int64), np.array([of_term[r.term] for r in rows], np.int64)
        asked = _Asked(ids, len(terms), q, t, np.array([r.qtf for r in rows]) * weight[t], k, self.k1, self.b, length, to_arrow_type(kind))
        sent = self.spark.sparkContext.broadcast(asked)

        def scored(groups: DataFrame, least: Broadcast | None) -> DataFrame:
            # A row for each of the groups, of which there is one for some hundred documents; they are distinct.
            own = packs.join(F.broadcast(groups), ["segment", "g"]).select("segment", "g", "terms", *PACKED)
            chosen = own.mapInArrow(_wanted(wanted, CHOSEN), f"segment string, g int, doc_ids binary, lens binary, {ints(CHOSEN)}")
            lists = chosen.groupBy("segment", "g").agg(F.first("doc_ids").alias("doc_ids"), F.first("lens").alias("lens"), F.collect_list(F.struct(*CHOSEN)).alias("x"))
            if body["deleted"]:
                gone = self._rows("deleted", body["deleted"]).groupBy("segment", "g").agg(F.collect_list("doc_id").alias("gone"))
                lists = lists.join(gone, ["segment", "g"], "left")
            else:
                lists = lists.withColumn("gone", F.lit(None).cast("array<long>"))
            flat = lists.select("doc_ids", "lens", *(F.flatten(f"x.{c}").alias(c) for c in CHOSEN), "gone")
            return flat.mapInArrow(_scores(sent, least), f"query_id {kind.simpleString()}, doc_id long, score double")

        best = heads.mapInArrow(_bounds(sent, None), "q int, segment string, g int, most double")
        first = top(best.withColumnRenamed("q", "query_id").withColumn("place", F.struct("segment", "g")), FIRST_GROUPS, "most", "place").select("segment", "g").distinct()
        least = np.full(len(ids), -np.inf)
        kth = top(scored(first, None), k).where(F.col("rank") == k)
        for r in kth.collect():  # a row a query
            least[of_id[r.query_id]] = r.score - MARGIN
        limit = self.spark.sparkContext.broadcast(least)
        through = heads.mapInArrow(_bounds(sent, limit), "q int, segment string, g int, most double").checkpoint()
        names = self.spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {kind.simpleString()}")
        of_kind = lambda g: F.coalesce(F.sum(F.when(F.col("g") == g, F.col("most"))), F.lit(0)).cast("long")
        counts = through.where("segment IS NULL").groupBy("q").agg(of_kind(0).alias("n_blocks"), of_kind(1).alias("n_read"))
        reads = counts.join(names, "q").select("query_id", "n_blocks", "n_read")
        # Scored here, since batches are only small within a pass. What is kept is k rows of a query for each task.
        return None if only_reads else scored(through.where("segment IS NOT NULL").select("segment", "g"), limit).checkpoint(), reads


def _bucket(term: bytes | memoryview) -> int:
    return crc32(term) % BUCKETS


def _bytes(terms: pa.Array) -> tuple[memoryview, list[int]]:
    """The bytes of strings that are no slice, and where each begins and ends."""
    return memoryview(terms.buffers()[2] or b""), np.frombuffer(terms.buffers()[1], np.int32)[: len(terms) + 1].tolist()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed blocks of rows (doc_id, len, g, joined, sizes, tfs) in order of g; a group at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        g = b.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("g")[0].as_py() != g[lo]:
                yield from _of_group(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    yield from _of_group(held)


def _of_group(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed blocks of a group, a row for each bucket that has terms."""
    bytes_of, tf = (np.concatenate([b.column(c).flatten().to_numpy() for b in parts] or [[]]) for c in ("sizes", "tfs"))
    if not len(tf):
        return
    ends = np.concatenate(([0], np.cumsum(bytes_of))).astype(np.int32)
    joined = pa.StringArray.from_buffers(len(tf), pa.py_buffer(ends), pa.py_buffer(b"".join(x for b in parts for x in b.column("joined").to_pylist())))
    each = np.concatenate([b.column("tfs").value_lengths().to_numpy() for b in parts])
    docs, lens = (np.concatenate([b.column(c).to_numpy() for b in parts]) for c in ("doc_id", "len"))
    by_id = np.argsort(docs)
    at = np.repeat(np.argsort(by_id), each)
    terms, code = _coded(joined)
    data, ends = _bytes(terms)
    bucket = np.array([_bucket(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    by_bucket = np.argsort(bucket, kind="stable")
    code = np.argsort(by_bucket)[code]
    order = np.argsort(code * len(docs) + at)
    code, at, tf = code[order], at[order], tf[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    starts = np.append(starts, len(code))
    ordered = terms.take(pa.array(by_bucket))
    data, ends = _bytes(ordered)  # not as Python strings, of which a group has tens of thousands
    of_terms = {"sizes": pc.binary_length(ordered).to_numpy(), "n": np.diff(starts), "max_tf": np.maximum.reduceat(tf, starts[:-1]), "min_len": np.minimum.reduceat(lens[by_id][at], starts[:-1])}
    of_group, of_postings = {"doc_ids": docs[by_id], "lens": lens[by_id]}, {"at": at, "tfs": tf}
    rows, cuts = [], np.searchsorted(bucket[by_bucket], np.arange(BUCKETS + 1)).tolist()
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if lo == hi:
            continue
        arrays = {**{c: x[lo:hi] for c, x in of_terms.items()}, **of_group, **{c: x[starts[lo] : starts[hi]] for c, x in of_postings.items()}}
        packed = {c: arrays[c].astype(kind).tobytes() for c, kind in PACKED.items()}
        rows.append({"bucket": i, "g": parts[0].column("g")[0].as_py(), "terms": data[ends[lo] : ends[hi]].tobytes(), **packed})
    kinds = {"bucket": pa.int32(), "g": pa.int32(), "terms": pa.binary(), **dict.fromkeys(PACKED, pa.binary())}
    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _unpacked(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), PACKED[column])


def _found(batch: pa.RecordBatch, known: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, where its terms are known, which of the known ones they are) of rows of packed blocks that have any."""
    sizes = [_unpacked(batch, "sizes", i) for i in range(batch.num_rows)]
    ends = np.concatenate(([0], np.cumsum(np.concatenate([[], *sizes])))).astype(np.int32)
    joined = pa.py_buffer(b"".join(batch.column("terms").to_pylist()))
    place = pc.index_in(pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), joined), value_set=known).fill_null(-1).to_numpy()
    for i, own in enumerate(np.split(place, np.cumsum([len(x) for x in sizes])[:-1]) if sizes else []):
        has = np.flatnonzero(own >= 0)
        if len(has):
            yield i, has, own[has]


def _wanted(wanted: Broadcast, columns: dict[str, pa.DataType]):
    """Over rows of packed blocks: those blocks whose terms are wanted, with postings (and the group's documents) if columns have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(wanted.value, pa.string())
        for batch in batches:
            rows, out = [], {c: [] for c in columns}
            for i, has, t in _found(batch, known):
                rows.append(i)
                of = {c: _unpacked(batch, c, i) for c in columns if c != "t"}
                mask = np.zeros(len(of["n"]), bool)
                mask[has] = True
                postings = np.repeat(mask, of["n"]) if "at" in of else None
                out["t"].append(t)
                for c, x in of.items():
                    out[c].append(x[postings if c in ("at", "tfs") else has])
            same = [c for c in ("segment", "g", "doc_ids", "lens") if c in batch.schema.names]
            kept = {c: batch.column(c).take(pa.array(rows, pa.int32())) for c in same}
            yield pa.RecordBatch.from_pydict({**kept, **{c: pa.array(out[c], kind) for c, kind in columns.items()}})

    return run


def _sum_rows(df: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(df)
    return pa.RecordBatch.from_pydict({"t": pa.array(some, pa.int32()), "n": pa.array(df[some], pa.int64())})


def _postings(n_terms: int):
    """Over rows (t, n): the postings of each term in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            np.add.at(df, b.column("t").flatten().to_numpy(), b.column("n").flatten().to_numpy())
        yield _sum_rows(df)

    return run


def _occur(wanted: Broadcast):
    """Over rows (terms): in how many of a task each wanted term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = pa.array(wanted.value, pa.string()), np.zeros(len(wanted.value), np.int64)
        for b in batches:
            place = pc.index_in(b.column("terms").flatten(), value_set=known).drop_null().to_numpy()
            df += np.bincount(place, minlength=len(df))
        yield _sum_rows(df)

    return run


def _sums(rows: DataFrame, n_terms: int) -> np.ndarray:
    """n by term of rows (t, n)."""
    out = np.zeros(n_terms, np.int64)
    for r in rows.groupBy("t").agg(F.sum("n").alias("n")).collect():  # a row a wanted term
        out[r.t] = r.n
    return out


@dataclass
class _Asked:
    """Terms of queries, as tasks hold them: entry i gives query q[i] the weight w[i] for term t[i]."""

    ids: list
    n_terms: int
    q: np.ndarray
    t: np.ndarray
    w: np.ndarray
    k: int
    k1: float
    b: float
    length: float
    kind: pa.DataType

    def part(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a posting gives for a weight of 1."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size / self.length))

    def bounds(self, terms: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries that have any of the terms, how many, and what terms that give most for a weight of 1 can sum up to."""
        gives = np.full(self.n_terms, -1.0)
        gives[terms] = most
        some = np.flatnonzero(gives[self.t] >= 0)
        q, w = self.q[some], self.w[some]
        has, bound = np.bincount(q[w != 0], minlength=len(self.ids)), np.bincount(q, np.maximum(w * gives[self.t[some]], 0), len(self.ids))
        queries = np.unique(q)
        return queries, has[queries], bound[queries]

    def matrices(self, terms: np.ndarray, among: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, weights [queries, terms]) of the queries, among some, that have any of the terms; in blocks."""
        place = np.full(self.n_terms, -1)
        place[terms] = np.arange(len(terms))
        has = np.flatnonzero(place[self.t] >= 0)
        if among is not None:
            has = has[among[self.q[has]]]
        queries, row = np.unique(self.q[has], return_inverse=True)
        for at in range(0, len(queries), QUERY_BLOCK):
            some = queries[at : at + QUERY_BLOCK]
            own = (row >= at) & (row < at + QUERY_BLOCK)
            w = np.zeros((len(some), len(terms)))
            w[row[own] - at, place[self.t[has[own]]]] = self.w[has[own]]
            yield some, w


def _rows_of(batch: pa.RecordBatch, *columns: str) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays of some list columns, row by row."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].values.to_numpy() for c in columns)


def _bounds(sent: Broadcast, least: Broadcast | None):
    """Over rows (segment, g, t, max_tf, min_len). Without thresholds: for each query the groups of a task that can reach most. With them: the
    groups that reach one; and rows without segment, counting the query's blocks (g 0) and those in groups that reach its own (g 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Asked = sent.value
        n = len(asked.ids)
        high: list[list[tuple[float, str, int]]] = [[] for _ in range(n)]
        blocks, read = np.zeros(n), np.zeros(n)
        out: list[tuple] = []
        for batch in batches:
            for segment, g, (terms, tf, size) in zip(batch.column("segment").to_pylist(), batch.column("g").to_pylist(), _rows_of(batch, "t", "max_tf", "min_len"), strict=True):
                queries, has, bound = asked.bounds(terms, asked.part(tf.astype(float), size.astype(float)))
                if least is None:
                    for q, x in zip(queries.tolist(), bound.tolist(), strict=True):
                        if len(high[q]) < FIRST_GROUPS or (-x, segment, g) < high[q][-1]:
                            high[q] = sorted([*high[q], (-x, segment, g)])[:FIRST_GROUPS]
                    continue
                through = bound >= least.value[queries]
                blocks[queries] += has
                read[queries] += has * through
                if through.any():
                    out.append((None, segment, g, 0.0))
        out += [(q, s, g, -x) for q, places in enumerate(high) for x, s, g in places]
        if least is not None:
            out += [(q, None, kind, float(x)) for kind, counts in enumerate((blocks, read)) for q, x in enumerate(counts) if x]
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.float64()), strict=True)], ["q", "segment", "g", "most"])

    return run


def _scores(sent: Broadcast, least: Broadcast | None):
    """Over groups (doc_ids, lens, t, n, max_tf, min_len, at, tfs, gone): a task's k best documents of every query among those in groups
    that reach the query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Asked = sent.value
        held, n_held, limit = [], 0, HELD

        def best_of(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, doc, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((doc, -score, q))
            q = q[order]
            order = order[np.arange(len(q)) - np.searchsorted(q, q) < asked.k]
            return tuple(np.concatenate(x)[order] for x in zip(*parts, strict=True))

        for batch in batches:
            for i, ((terms, n, max_tf, min_len, at, tf), gone) in enumerate(zip(_rows_of(batch, *CHOSEN), batch.column("gone").to_pylist(), strict=True)):
                docs, sizes = _unpacked(batch, "doc_ids", i), _unpacked(batch, "lens", i)
                gives = np.zeros((len(terms), len(docs)))
                gives[np.repeat(np.arange(len(terms)), n), at] = asked.part(tf.astype(float), sizes[at].astype(float))
                if gone:
                    kept = ~np.isin(docs, gone)
                    docs, gives = docs[kept], gives[:, kept]
                among = None
                if least is not None:
                    queries, _, bound = asked.bounds(terms, asked.part(max_tf.astype(float), min_len.astype(float)))
                    among = np.zeros(len(asked.ids), bool)
                    among[queries[bound >= least.value[queries]]] = True
                for queries, w in asked.matrices(terms, among):
                    if not len(docs):
                        continue
                    scores = w @ gives
                    ranked = np.where(scores == 0, -np.inf, np.round(scores, 6))  # 0: none of the query's terms
                    best = np.lexsort((np.broadcast_to(docs, ranked.shape), -ranked), axis=1)[:, : asked.k]
                    got = np.take_along_axis(ranked, best, 1)
                    rows, places = np.nonzero(got > -np.inf)
                    held.append((queries[rows], docs[best[rows, places]], got[rows, places]))
                    n_held += len(rows)
                if n_held > limit:
                    held = [best_of(held)]
                    n_held = len(held[0][0])
                    limit = n_held + HELD
        if n_held:
            q, doc, score = best_of(held)
            names = pa.array(asked.ids, asked.kind).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([names, pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])

    return run
