"""From raw documents to token ids: the stages of a training corpus.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run()
writes each stage's rows as Parquet in the session's shared folder and reads them again. A stage
takes any table with the columns of documents, whatever other columns it has and however long its
texts are; an empty one gives an empty one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, mixing, pieces, simhash, toxicity
from lodestone.llm.common import SPACES, documents, held_out, packed, unpacked, use_checkpoints
from lodestone.llm.queries import PIECES


def _row_key() -> Column:
    """What tells packed rows apart: the id (null last), the source and hashes of the text and of the other
    columns; equal rows share it."""
    of = F.col("row").getField
    return F.struct(of("doc_id").isNull().alias("none"), of("doc_id").alias("doc_id"), of("source").alias("source"), F.xxhash64(of("text")).alias("hash"), F.xxhash64(F.to_json(F.col("row").dropFields("text"))).alias("all"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. It is fitted here, on these documents and
    the labels outside of the held-out fold; without labels nothing is rejected. Null and empty texts
    stay; repeated rows stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 4))
    return toxicity.below(docs, toxicity.fit(docs, labels))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur in other documents before them. A text
    may become empty; a null one stays. Repeated rows lose the same lines."""
    left = packed(line_dedup.drop_recurring(docs, dropped=None))
    return left.select(*unpacked(docs.columns, {"n_chars": F.length(F.col("row").getField("text")).cast("long")}))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the lowest id (null last), of each group linked by five-word shingle sets
    of similarity 0.8 or more: by SimHash fingerprints under Golay keys, verified by the whole sets, and by
    bands of minima for what lies beyond their four bits. Null and blank texts are alike; of repeated rows one stays."""
    keyed = packed(docs).withColumn("key", _row_key())
    found = simhash.near_duplicates(keyed.select("key", F.col("row").getField("text").alias("text")), "key", by="shingles")
    stays = found.where("key = component").select(F.struct("key").alias("stays")).distinct()
    # Repeated rows are one before the join, so that both of its sides have a key once.
    once = keyed.groupBy("key").agg(F.first("row").alias("row"))
    return once.join(stays, F.struct("key") == F.col("stays")).select(*unpacked(docs.columns))


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, n at least 1 and less than its words."""
    spaced = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    parts = F.split(spaced, " ", -1)
    filled = F.filter(F.transform(parts, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
    return F.substring(text, F.lit(1), F.length(F.array_join(F.slice(parts, F.lit(1), F.get(filled, n - 1) + 1), " ")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document as many whole times as it is taken, then once more up
    to the word where its last words end. Documents that are not taken go, so those without words do.
    What repeated rows take is put together: each comes as often as all do, the first one for the rest."""
    keyed = packed(docs).withColumn("key", _row_key())
    of = F.col("row").getField
    mixed = mixing.mix(keyed.select("key", of("text").alias("text"), of("source").alias("source")), "key")
    by = mixed.groupBy("key").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("size").alias("size")).where("taken > 0")
    by = by.withColumn("each", F.floor(F.col("taken") / (F.col("size") * F.col("n"))).cast("int"))
    by = by.withColumn("rest", F.col("taken") - F.col("each") * F.col("size") * F.col("n")).select(F.struct("key").alias("of"), "n", "size", "each", "rest").checkpoint()
    met = lambda rows, by: rows.join(by, F.struct("key") == F.col("of"))
    none = F.array().cast("array<int>")
    last = lambda words: F.when(words > 0, F.array(words.cast("int"))).otherwise(none)
    # A part is the words of a copy, 0 for all of them.
    alone = F.when(F.col("n") == 1, last(F.col("rest"))).otherwise(none)
    parts = met(keyed, by).select("row", F.explode(F.concat(F.array_repeat(F.lit(0), F.col("each")), alone)).alias("part"))
    more = met(keyed, by.where("n > 1 AND rest > 0")).groupBy("key").agg(F.first("row").alias("row"), F.first("rest").alias("rest"), F.first("size").alias("size"))
    whole = F.floor(F.col("rest") / F.col("size")).cast("int")
    parts = parts.union(more.select("row", F.explode(F.concat(F.array_repeat(F.lit(0), whole), last(F.col("rest") % F.col("size")))).alias("part")))
    text = F.when(F.col("part") > 0, _first_words(of("text"), F.col("part"))).otherwise(of("text"))
    return parts.select(*unpacked(docs.columns, {"text": text, "n_chars": F.length(text).cast("long")}))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens long, ids array<int>, text decoded from the ids) of every row; a null
    text is an empty one without ids."""
    keyed = docs.select(F.struct("doc_id", "source").alias("row"), "text")
    coded = pieces.round_trip(keyed, public_tokenizers.path(PIECES), key="row")
    return coded.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: SQL expresses neither the toxicity model nor SimHash components nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below sf_dir. What a stage wrote is deleted once the next one has
    been written, or has failed; the caller's rows are in the last one's folder, below the checkpoints."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, last = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        try:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        finally:
            if last:
                _delete(spark, last)
        last = f"{folder}/{k}"
        docs = spark.read.parquet(last)
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
