"""Exact inverted lists against looking at everything; durable quantised indexes and what they refuse."""

import json
from pathlib import Path

import numpy as np
import pytest

from lodestone.operators import dense, ivf, quantise
from lodestone.sources import manifest

SCHEMA = "vec_id long, embedding array<double>"


def cloud(n=900, dim=6, seed=2):
    """Clusters, equal vectors, zero vectors, null vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim)) * 3
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=dim)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[i][1]) for i in range(40)] + [(n + 50 + i, [0.0] * dim) for i in range(3)] + [(n + 60, None), (None, None)]


def rows_of(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_lists_are_exact_and_look_at_less(spark, metric):
    points = spark.createDataFrame(cloud(), SCHEMA).where("vec_id IS NOT NULL OR embedding IS NULL").repartition(3)
    asked = points.where("vec_id % 20 = 0 OR vec_id > 948")
    index = ivf.build(points, 8, metric, block=32)
    for k in (1, 12):
        got, reads = ivf.search(index, asked, k)
        assert rows_of(got) == rows_of(dense.search(asked, points, k, metric))
        r = reads.collect()[0]
        assert 0 < r.n_looked < r.n_all / 2
    assert rows_of(ivf.search(index, asked, 5, n_probe=8)[0]) == rows_of(dense.search(asked, points, 5, metric))
    some, reads = ivf.search(index, asked, 5, n_probe=1)
    assert set(rows_of(some)) != set() and reads.collect()[0].n_looked < r.n_all / 4
    assert ivf.search(index, asked, 0)[0].count() == 0


def test_lists_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(7, [1.0, 2.0])], SCHEMA)
    assert ivf.search(ivf.build(none, 3), one, 5)[0].count() == 0
    index = ivf.build(one, 3)
    assert rows_of(ivf.search(index, one, 5)[0]) == [(7, 1, 7, 1.0)] and ivf.search(index, none, 5)[0].count() == 0
    with pytest.raises(ValueError):
        ivf.build(one, 3, "other")


def test_null_vectors_are_left_out(spark):
    points = spark.createDataFrame(cloud(100), SCHEMA).repartition(2)
    index = quantise.fit_ivfpq(points, 4, 2, 4)
    codes = quantise.encode(points, index)
    assert codes.count() == quantise.assign(points, index.centroids).count() == quantise.residuals(points, index.centroids).count() == 143
    assert quantise.search(codes, index, points.where("vec_id > 148"), 3).count() == 3 * 3
    with pytest.raises(ValueError):
        quantise.fit_ivfpq(points.where("embedding IS NULL"), 4, 2, 4)


def test_lloyd_passes_are_those_of_numpy(spark):
    x = np.array([v for _, v in cloud(200) if v])
    points = spark.createDataFrame(list(enumerate(x.tolist())), SCHEMA).repartition(5)
    start = x[:6]
    want = start.copy()
    for _ in range(4):
        near = quantise.nearest(x, want)
        want = np.array([x[near == i].mean(0) if (near == i).any() else want[i] for i in range(6)])
    assert np.allclose(quantise.lloyd(quantise._packed(points), start[None], 4)[0], want)


@pytest.fixture
def saved(spark, tmp_path):
    points = spark.createDataFrame(cloud(100), SCHEMA).where("vec_id IS NOT NULL")
    index = quantise.fit_ivfpq(points, 4, 2, 3)
    codes = quantise.encode(points, index).cache()
    path = str(tmp_path / "index")
    assert quantise.save(codes, index, path) == 1
    return path, codes, index


def test_versions(spark, saved):
    path, codes, index = saved
    assert quantise.save(codes.where("vec_id < 50"), index, path) == 2
    assert [quantise.load(spark, path, v)[0].count() for v in (None, 2, 1)] == [50, 50, 143]
    for missing in (f"{path}-none", path + "/codes"):
        with pytest.raises(FileNotFoundError):
            quantise.load(spark, missing)
    with pytest.raises(FileNotFoundError):
        quantise.load(spark, path, 9)


@pytest.mark.parametrize(
    ("broken", "said"),
    [
        ("SELECT vec_id, -1L AS cluster, codes FROM c", "clusters"),
        ("SELECT vec_id, 4L AS cluster, codes FROM c", "clusters"),
        ("SELECT vec_id, cluster, CAST(NULL AS BINARY) AS codes FROM c", "null"),
        ("SELECT IF(vec_id = 3, NULL, vec_id) AS vec_id, cluster, codes FROM c", "null"),
        ("SELECT vec_id, cluster, X'00' AS codes FROM c", "length"),
        ("SELECT vec_id, cluster, X'0008' AS codes FROM c", "beyond"),
        ("SELECT vec_id, cluster, codes FROM c UNION ALL SELECT * FROM c WHERE vec_id = 3", "repeated"),
        ("SELECT * FROM c WHERE false", "no vectors"),
        ("SELECT * FROM c WHERE vec_id <> 3", "manifest"),
        ("SELECT vec_id, 0L AS cluster, codes FROM c", "manifest"),
    ],
)
def test_broken_codes(spark, saved, broken, said):
    """Each broken table is refused when it is saved, or else, if only the manifest tells, when it has been put in place of the codes."""
    path, codes, index = saved
    codes.createOrReplaceTempView("c")
    bad = spark.sql(broken)
    if said == "manifest":
        name = manifest.read(spark, path)[1]["codes"]
        bad.write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/{name}")
        with pytest.raises(ValueError, match=said):
            quantise.load(spark, path)
        assert quantise.load(spark, path, check=False)[0].count() == bad.count()
        return
    with pytest.raises(ValueError, match=said):
        quantise.save(bad, index, path)
    assert manifest.versions(spark, path) == [1]


def test_broken_models_and_old_folders(spark, saved, tmp_path):
    path, codes, index = saved
    model = manifest.read(spark, path)[1]["model"]
    there = spark.read.parquet(f"{path}/{model}")
    rows = spark.createDataFrame(there.collect(), there.schema)
    rows.where("kind = 'centroid' OR m = 0").write.mode("overwrite").parquet(f"{path}/{model}")
    with pytest.raises(ValueError, match="model"):
        quantise.load(spark, path)
    old = str(tmp_path / "old")
    codes.write.partitionBy("cluster").parquet(f"{old}/codes")
    rows.write.parquet(f"{old}/model")
    loaded, again = quantise.load(spark, old)
    assert loaded.count() == 143 and np.array_equal(again.words, index.words)
    file = next(Path(path).glob("manifest-*.json"))
    Path(path, f".{file.name}.crc").unlink(missing_ok=True)
    file.write_text(json.dumps(json.loads(file.read_text()) | {"format": 9}))
    with pytest.raises(ValueError, match="later version"):
        quantise.load(spark, path)


def test_a_worker_is_handed_few_pairs_of_blocks(spark, sf_dir, monkeypatch):
    """Pairs hold a megabyte each; the session's batch size, of thousands of rows, is set back."""
    scan, seen, before = ivf._scan, [], spark.conf.get(ivf.PER_BATCH)

    def watched(*args):
        seen.append(int(spark.conf.get(ivf.PER_BATCH)))
        return scan(*args)

    monkeypatch.setattr(ivf, "_scan", watched)
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ivf.search(ivf.build(points, 4, passes=1), points.where("vec_id < 3"), 2)
    assert seen == [ivf.PAIRS] * 2 and spark.conf.get(ivf.PER_BATCH) == before
