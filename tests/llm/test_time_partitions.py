"""Layouts by time against a plain loop over rows, and the files themselves."""

import hashlib
import zlib
from calendar import monthrange
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, time_partitions

CUT = datetime(2024, 3, 1)


def leaves(moments, limit):
    """name -> rows; moments is a list of (moment, row)."""
    known = [x for x in moments if x[0] is not None]
    out = {}

    def walk(rows, path):
        if not path:
            members = range(min(m.year for m, _ in rows), max(m.year for m, _ in rows) + 1)
        else:
            members = [range(1, 13), range(1, 1 + monthrange(*path[:2])[1]) if len(path) > 1 else (), range(24)][len(path) - 1]
        run = []
        for k in [*members, None]:
            own = [x for x in rows if k is not None and (x[0].year, x[0].month, x[0].day, x[0].hour)[len(path)] == k]
            joins = k is not None and len(own) <= limit and run and run[-1][1] is not None and sum(len(r) for _, r in run) + len(own) <= limit
            if not joins:
                if sum(len(r) for _, r in run):
                    width = 2 if path else 4
                    out["/".join([f"{p:0{4 if i == 0 else 2}d}" for i, p in enumerate(path)] + [f"{run[0][0]:0{width}d}-{run[-1][0]:0{width}d}"])] = [x for _, r in run for x in r]
                run = []
            if k is not None and len(own) > limit and len(path) < 3:
                walk(own, (*path, k))
            elif k is not None:
                run.append((k, own))

    if known:
        walk(known, ())
    if len(known) < len(moments):
        out["null"] = [x for x in moments if x[0] is None]
    return out


def files(rows, moment, limit):
    """(leaf, part) -> rows in order; rows are tuples whose second to fourth are click_id, ts, arrived_at."""
    low = lambda x: (x is not None, x if x is not None else 0)
    out = {}
    for leaf, held in leaves([(moment(r), r) for r in rows], limit).items():
        held = [r for _, r in sorted(held, key=lambda x: (low(x[0]), low(x[1]["arrived_at"]), low(x[1]["click_id"]), str(x[1])))]
        for i in range(0, len(held), limit):
            out[leaf, 1 + i // limit] = held[i : i + limit]
    return out


def click_moment(r):
    if r["ts"] is None or r["click_id"] is None:
        return r["ts"]
    k = zlib.crc32(str(r["click_id"]).encode()) % 128
    if k > 111:
        day = datetime(r["ts"].year, r["ts"].month, r["ts"].day)
        return day - timedelta(days=day.weekday())
    return r["ts"] - timedelta(days=(k + 6) ** 3 if k < 16 else 0)


def same(got, rows, moment, early, folder_of, n_files=650):
    limit = 1 + len(rows) // n_files
    start, final = files([r for r in rows if early(r)], moment, limit), files(rows, moment, limit)
    bag = lambda held: Counter(map(str, held))
    listed = {(r.leaf, r.part): r for r in got}
    assert len(listed) == len(got) and set(listed) == set(final)
    for k, held in final.items():
        r = listed[k]
        ids = ",".join("" if x["click_id"] is None else str(x["click_id"]) for x in held)
        assert (r.n_rows, r.n_new, r.ids_sha256) == (len(held), sum(not early(x) for x in held), hashlib.sha256(ids.encode()).hexdigest()), k
        assert r.rewritten == (k not in start or bag(start[k]) != bag(held))
        table = pq.ParquetFile(r.path.removeprefix("file://")).read()
        assert ",".join(table.column_names) == r.columns and [x["click_id"] for x in table.to_pylist()] == [x["click_id"] for x in held]
        assert bag(table.to_pylist()) == bag(held)
    if got:
        there = {str(p) for p in Path(folder_of).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}
        assert there == {r.path.removeprefix("file://") for r in got}
    return listed


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    got = queries.op11_time_partitions(spark, f"/root/testdata/{sf}").collect()
    rows = pq.read_table(f"/root/testdata/{sf}/clicks.parquet").to_pylist()
    same(got, rows, click_moment, lambda r: r["arrived_at"] < CUT, Path(got[0].path.removeprefix("file://")).parents[2])
    assert {r.rewritten for r in got} == {True, False}


def test_edge_rows(spark, tmp_path):
    """Null moments, order columns and ids, an hour far over the limit, a row a third of all, clashing names, far years, long texts."""
    base = datetime(2023, 12, 31, 23, 30)
    rows = [{"click_id": i % 40, "ts": base + timedelta(minutes=17 * (i % 90)), "arrived_at": None if i % 11 == 0 else CUT + timedelta(seconds=i - 60), "part": f"p{i % 3}", "leaf": None, "row": i % 2, "hour": "x" * (20_000 if i == 5 else 1)} for i in range(120)]
    rows += [{"click_id": 7, "ts": base, "arrived_at": CUT - timedelta(days=1), "part": None, "leaf": None, "row": 1, "hour": None}] * 70
    rows += [{"click_id": i if i % 2 else None, "ts": None, "arrived_at": CUT - timedelta(days=i % 2), "part": None, "leaf": 1, "row": 0, "hour": ""} for i in range(30)]
    rows += [{"click_id": 1, "ts": datetime(1890, 2, 28, 1), "arrived_at": CUT, "part": None, "leaf": None, "row": None, "hour": None}]
    df = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, part string, leaf int, row int, hour string").repartition(3)
    folder = str(tmp_path / "out")
    early = lambda r: r["arrived_at"] is not None and r["arrived_at"] < CUT
    out = time_partitions.grow_layout(df, F.col("arrived_at") < F.lit(CUT).cast("timestamp_ntz"), F.col("ts"), ["arrived_at", "click_id"], folder, files=15)
    got = out.collect()
    assert got[0].columns == "click_id,ts,arrived_at,_part,_leaf,row,hour"
    limit = 1 + len(rows) // 15
    want = files(rows, lambda r: r["ts"], limit)
    assert {(r.leaf, r.part): r.n_rows for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        held = pq.ParquetFile(r.path).read().rename_columns(list(rows[0])).to_pylist()
        assert [(x["ts"], x["arrived_at"], x["click_id"]) for x in held] == [(x["ts"], x["arrived_at"], x["click_id"]) for x in want[r.leaf, r.part]]
        assert r.n_new == sum(not early(x) for x in held)
    assert sum(r.n_rows for r in got) == len(rows)


def test_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz")
    early = F.col("arrived_at").isNotNull()
    assert time_partitions.grow_layout(df, early, F.col("ts"), ["arrived_at", "click_id"], str(tmp_path / "a")).collect() == []
    one = spark.createDataFrame([(1, None, None)], df.schema)
    got = time_partitions.grow_layout(one, early, F.col("ts"), ["arrived_at", "click_id"], str(tmp_path / "b")).collect()
    assert [(r.leaf, r.part, r.n_rows, r.n_new, r.rewritten) for r in got] == [("null", 1, 1, 1, True)]


def test_merging_is_associative_and_descent_finds_the_leaf():
    rng = np.random.default_rng(3)
    tries = []
    for _ in range(4):
        hours = np.unique(rng.integers(-5000, 400_000, 60))
        trie: dict = {}
        time_partitions.add(trie, np.append(hours, time_partitions.NEVER), rng.integers(0, 9, (len(hours) + 1, 2)))
        tries.append((hours, trie))
    copy = lambda t: time_partitions._unpacked(time_partitions._packed(t))
    a, b, c, d = (copy(t) for _, t in tries)
    one = time_partitions.merged(time_partitions.merged(time_partitions.merged(a, b), c), d)
    a, b, c, d = (copy(t) for _, t in tries)
    other = time_partitions.merged(time_partitions.merged(a, b), time_partitions.merged(c, d))
    assert [time_partitions.total(x, 1) for x in (one, other)] == [sum(time_partitions.total(t, 1) for _, t in tries)] * 2
    x, y = time_partitions.fold(one, 1, 30), time_partitions.fold(other, 1, 30)
    assert (x.names, x.rows) == (y.names, y.rows) and len(set(x.names)) == len(x.names)
    hours = np.unique(np.concatenate([h for h, _ in tries]))
    found = time_partitions.descended(x.folded, hours)
    assert (np.diff(found) >= 0).all() and set(found) <= set(range(len(x.names)))
