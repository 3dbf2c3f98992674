"""Live memories in any split of batches, and folders of files that grow."""

import random


from lodestone.operators import dialogue
from lodestone.streaming import ingest, memory

EVENTS = "conv_id long, seq long, op string, key string, value string"


def events(n=160, seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choices(["set", "pop", "clear", "other"], [8, 3, 1, 1])[0]
        rows.append((rng.randrange(6), i, op, None if op == "clear" else f"k{rng.randrange(4)}", f"v{i}" if op == "set" and i % 9 else None))
    return rows


def test_memories_are_those_of_the_whole_log(spark, tmp_path):
    """In order and out of it, in batches of any size; a restart goes on; an empty memory is no row; null values are held."""
    rows = events()
    whole = spark.createDataFrame(rows, EVENTS)
    want = sorted((r.conv_id, r.key, str(r.value)) for r in dialogue.working_memory(whole).collect())
    mixed = random.Random(1).sample(rows, len(rows))
    for name, log, cuts in (("ordered", rows, [0, 50, 51, 160]), ("mixed", mixed, [0, 90, 160])):
        source, target = str(tmp_path / name / "in"), str(tmp_path / name / "out")
        for a, b in zip(cuts, cuts[1:]):
            spark.createDataFrame(log[a:b], EVENTS).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(whole.schema).parquet(source)
            memory.remember(stream, target, str(tmp_path / name / "progress"))
        got = memory.snapshot(spark, target)
        assert sorted((r.conv_id, r.key, str(r.value)) for r in got.collect()) == want
        assert len({x for p in (tmp_path / name / "out").iterdir() if p.is_dir() for x in [p.name]}) == len(cuts) - 1


def test_files_that_arrive(spark, tmp_path):
    source = tmp_path / "in"
    (source / "deep").mkdir(parents=True)
    (source / "a.md").write_text("# A\nfirst text")
    (source / "deep" / "b.txt").write_bytes(b"\xff\xfe")
    go = lambda: ingest.ingest_files(spark, str(source), str(tmp_path / "out"), str(tmp_path / "progress"), 20, 5)
    assert go() == {"files": 2, "documents": 1, "rejected": 1}
    (source / "deep" / "c.txt").write_text("second text, long enough for two chunks")
    (source / "d.pdf").write_text("x")
    assert go() == {"files": 2, "documents": 1, "rejected": 1}
    assert go() == {"files": 0, "documents": 0, "rejected": 0}
    chunks = spark.read.parquet(f"{tmp_path}/out/chunks").collect()
    names = [r.metadata.file_name for r in chunks]
    assert names.count("a.md") == 1 and names.count("c.txt") >= 2 and len(set((r.doc_id, r.ordinal) for r in chunks)) == len(chunks)
    bad = spark.read.parquet(f"{tmp_path}/out/rejected").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in bad) == [("b.txt", "not UTF-8"), ("d.pdf", "unsupported format")]
