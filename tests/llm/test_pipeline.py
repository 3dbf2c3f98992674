"""The pipeline's stages against plain Python, each on its own input."""

import re
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lodestone.llm import mixing, toxicity
from lodestone.llm.common import documents, held_out, packed, use_checkpoints
from tests.llm.test_line_dedup import brute as dropped_lines
from tests.llm.test_resemblance import brute as brute_groups

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows that each stage leaves, documents first."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = documents(spark, SF), []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out.append(docs)
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
    return [*out, docs]


def test_columns_stay_until_the_last_stage(kept):
    assert all(df.columns == COLUMNS for df in kept[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, kept):
    model = toxicity.fit(kept[0], spark.read.parquet(f"{SF}/labels.parquet").where(~held_out(F.col("doc_id"), 4)))
    seen = toxicity.Evidence(model)
    want = sorted(r.doc_id for r in kept[0].collect() if model.probability(seen.of(r.text)) < toxicity.THRESHOLD)
    assert sorted(r.doc_id for r in kept[1].collect()) == want
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean & set(want)) >= 0.97 * len(clean)


def test_recurring_lines(kept):
    rows = {r.doc_id: r.text for r in kept[1].collect()}
    gone = dropped_lines(list(rows.items()))
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k, t]) for k, t in rows.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in kept[2].collect()} == {k: (t, len(t)) for k, t in want.items()}


def test_one_document_of_each_group_stays(kept):
    rows = sorted((r.doc_id, r.text) for r in kept[2].collect())
    roots = brute_groups([t for _, t in rows])
    assert sorted((r.doc_id, r.text) for r in kept[3].collect()) == [rows[k] for k in sorted(set(roots))]


def test_mixed_words(kept):
    keyed = packed(kept[3]).withColumn("key", pipeline._row_key()).select("key", "row.text", "row.source")
    taken = {r.key.doc_id: r.taken for r in mixing.mix(keyed, "key").collect()}
    rows = Counter()
    whole = {r.doc_id: r.text for r in kept[3].collect()}
    for r in kept[4].collect():
        assert whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        rows[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert rows == Counter({k: n for k, n in taken.items() if n})


def test_ids_are_the_library_s(kept):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.PIECES))
    want = Counter((r.doc_id, r.source, tuple(sp.encode(r.text))) for r in kept[4].collect())
    rows = kept[5].collect()
    assert Counter((r.doc_id, r.source, tuple(r.ids)) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and r.text == sp.decode(r.ids) for r in rows)


def test_run_is_all_stages(spark, kept):
    got = pipeline.run(spark, SF).select("doc_id", F.hash("ids").alias("h")).collect()
    assert Counter(got) == Counter(kept[-1].select("doc_id", F.hash("ids").alias("h")).collect())


def test_run_leaves_one_folder(spark):
    before = set(folders(spark))
    pipeline.run(spark, "/root/testdata/sf0.001")
    assert [len(list(f.iterdir())) for f in set(folders(spark)) - before] == [1]


def folders(spark):
    use_checkpoints(spark)
    return Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).glob("pipeline-*")


ROWS = [(None, None, None, None, None), (None, "a b\nc", "en", "s", 5), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "some text  that\tis here", "en", "s", 23), (2, "some text  that\tis here", "en", "s", 23), (3, "long words " * 40_000, "en", "t", 440_000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the stages and operators use themselves.
INNER = "row key hash all stays component node size band bands taken n each rest part of by skey shard h got target dropped _dropped _on whole template at context total fp root name score line ids decoded"


@pytest.mark.parametrize("extra", [[], INNER.split(), ["_key", "_n", "_taken", "_part", "_size", "_mixed", "_takens", "_text", "_hash"]])
def test_stages_take_nulls_repeats_long_texts_other_columns_and_nothing(spark, extra):
    use_checkpoints(spark)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in extra:
        docs = docs.withColumn(c, F.lit(f"is {c}"))
    for table in (docs, docs.where("doc_id = 9")):
        n = table.count()
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = stage(spark, table, SF)
            assert k == 4 or out.columns == [*COLUMNS, *extra]
            got = out.collect()
            assert len(got) == {0: n, 1: n, 2: 4 * bool(n), 4: n}.get(k, len(got))
            if k < 4:
                assert all(r[c] == f"is {c}" for r in got for c in extra)
            if k == 3 and n:
                words = sum(len(r.text.split()) for r in got)
                assert abs(words - sum(len((r[1] or "").split()) for r in ROWS)) <= 3 * mixing.BLOCK_WORDS
            elif k in (0, 1) and n:
                assert sorted(map(str, got)) == sorted(map(str, table.collect()))


def test_repeated_rows_are_taken_as_often_together(spark):
    use_checkpoints(spark)
    texts = ["one two three four five", "six seven", " ".join(f"w{i}" for i in range(300))]
    rows = [(i, texts[i], "en", "ab"[i % 2], len(texts[i])) for i in (0, 0, 0, 0, 0, 1, 1, 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    keyed = packed(docs).withColumn("key", pipeline._row_key()).select("key", "row.text", "row.source")
    taken = Counter()
    for r in mixing.mix(keyed, "key").collect():
        taken[r.key.doc_id] += r.taken
    got = Counter()
    for r in pipeline.mix_sources(spark, docs, SF).collect():
        assert texts[r.doc_id].startswith(r.text)
        got[r.doc_id] += len(r.text.split())
    assert got == Counter({k: n for k, n in taken.items() if n})
