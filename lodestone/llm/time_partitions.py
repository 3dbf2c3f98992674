"""Adaptive time partitions: a table in files of at most so many rows, by stretches of time that fit.

Each input partition counts its rows in a trie of years, months, days and hours, and the tries are
merged in a tree of tasks, so that what reaches the driver has the size of the time that the table
spans, whatever its rows. A depth-first walk splits what has too many rows and folds neighbours that fit
together; rows then descend the folded trie, which every task has, to their leaf.

A leaf's rows lie in files of the same limit, by moment and further columns. Only hours (and rows without
a moment) can need several: their equal rows are counted first, then sorted over ranges of keys, and a
range's place in its leaf is what the ranges before it hold. No task sorts a leaf that is larger than a file.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import use_checkpoints, written

#: The hour that stands for no moment.
NEVER = -(2**62)
NULL = "null"


def hour_of(moment: Column) -> Column:
    """Hours since 1970, negative before; NEVER for null."""
    return F.coalesce(F.unix_date(moment.cast("date")).cast("long") * 24 + F.hour(moment), F.lit(NEVER))


def _path(hours: np.ndarray) -> tuple[list[int], ...]:
    """Year, month, day and hour of each number of hours."""
    days = (hours // 24).astype("datetime64[D]")
    months = days.astype("datetime64[M]")
    return (months.astype("datetime64[Y]").astype(int) + 1970).tolist(), (months.astype(int) % 12 + 1).tolist(), ((days - months).astype(int) + 1).tolist(), (hours % 24).tolist()


def add(trie: dict, hours: np.ndarray, counts: np.ndarray) -> None:
    """Add counts [hours, marks] to a trie: year -> month -> day -> counts [24, marks], and None -> those without a moment."""
    known = hours != NEVER
    if not known.all():
        trie[None] = trie.get(None, 0) + counts[~known].sum(0)
    for year, month, day, hour, n in zip(*_path(hours[known]), counts[known], strict=True):
        of_day = trie.setdefault(year, {}).setdefault(month, {}).get(day)
        if of_day is None:
            of_day = trie[year][month][day] = np.zeros((24, counts.shape[1]), np.int64)
        of_day[hour] += n


def merged(a: dict, b: dict) -> dict:
    """The trie of both tables' rows; associative, and takes a over."""
    for k, node in b.items():
        a[k] = node if k not in a else merged(a[k], node) if isinstance(node, dict) else a[k] + node
    return a


def _packed(trie: dict) -> bytes:
    return zlib.compress(pickle.dumps(trie))


def _unpacked(raw: bytes) -> dict:
    return pickle.loads(zlib.decompress(raw))


def count(df: DataFrame, moment: Column, marks: list[Column]) -> dict:
    """The trie of df: how many rows of each hour have each mark (a boolean column without nulls)."""
    n_marks = len(marks)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie: dict = {}
        for b in batches:
            if b.num_rows:
                hours, place = np.unique(b.column(0).to_numpy(), return_inverse=True)
                of = [np.bincount(place[b.column(1 + i).to_numpy(zero_copy_only=False)], minlength=len(hours)) for i in range(n_marks)]
                add(trie, hours, np.stack(of, 1))
        yield pa.RecordBatch.from_arrays([pa.array([_packed(trie)], pa.binary())], ["trie"])

    narrow = df.select(hour_of(moment).alias("hour"), *(m.alias(f"m{i}") for i, m in enumerate(marks)))
    tries = narrow.mapInArrow(grow, "trie binary").rdd.map(lambda r: bytes(r.trie))
    return _unpacked(tries.treeReduce(lambda a, b: _packed(merged(_unpacked(a), _unpacked(b))))) if tries.getNumPartitions() else {}


@dataclass
class Layout:
    """A folded trie: nested dictionaries whose ends are numbers of leaves. names and rows are by number."""

    folded: dict
    names: list[str]
    rows: list[int]
    limit: int


def total(trie: dict, mark: int) -> int:
    """Rows of a trie with a mark."""
    return sum(total(x, mark) if isinstance(x, dict) else int(x.reshape(-1, x.shape[-1])[:, mark].sum()) for x in trie.values())


def _members(node, depth: int, path: tuple[int, ...], years: list[int]) -> list[int]:
    """All siblings below a node, those without rows too."""
    if depth == 0:
        return list(range(min(years), 1 + max(years))) if years else []
    if depth == 1:
        return list(range(1, 13))
    if depth == 2:
        first = np.datetime64(f"{path[0]:04d}-{path[1]:02d}")
        return list(range(1, 1 + int((first + 1).astype("datetime64[D]").astype(int) - first.astype("datetime64[D]").astype(int))))
    return list(range(24))


def fold(trie: dict, mark: int, limit: int) -> Layout:
    """The leaves of the rows with a mark, in time order, those without a moment last.

    The years from the first moment to the last are siblings, and a node of more than limit rows splits
    into all its months, days or hours. A sibling within limit joins the run of the one directly before
    it if that stays within limit, else it starts a run; an hour above limit is a run of its own. Runs
    that have rows are leaves, named by their parents and their first and last member.
    """
    out = Layout({}, [], [], limit)

    def rows_of(node) -> int:
        return 0 if node is None else total(node, mark) if isinstance(node, dict) else int(node[..., mark].sum())

    def leaf(name: str, n: int) -> int:
        out.names.append(name)
        out.rows.append(n)
        return len(out.names) - 1

    def walk(node, path: tuple[int, ...]) -> dict:
        folded: dict = {}
        run: list[int] = []
        held = 0

        def close() -> None:
            if held:
                show = [f"{p:0{4 if i == 0 else 2}d}" for i, p in enumerate(path)]
                ends = "-".join(f"{k:0{2 if path else 4}d}" for k in (run[0], run[-1]))
                folded.update(dict.fromkeys(run, leaf("/".join([*show, ends]), held)))
            run.clear()

        for k in _members(node, len(path), path, years):
            child = node.get(k) if isinstance(node, dict) else node[k]
            n = rows_of(child)
            if n > limit and len(path) < 3:
                close()
                held = 0
                folded[k] = walk(child, (*path, k))
                continue
            if not run or held + n > limit:
                close()
                held = 0
            run.append(k)
            held += n
        close()
        return folded

    years = [y for y, x in trie.items() if y is not None and total(x, mark)]
    out.folded = walk({y: x for y, x in trie.items() if y is not None}, ())
    if n := rows_of(trie.get(None)):
        out.folded[None] = leaf(NULL, n)
    return out


def descended(folded: dict, hours: np.ndarray) -> np.ndarray:
    """The leaf of each hour (of distinct ones, since each is a walk down the trie)."""
    known = hours != NEVER
    out = np.full(len(hours), folded.get(None, -1), np.int32)
    found = []
    for path in zip(*_path(hours[known]), strict=True):
        node = folded
        for k in path:
            node = node[k]
            if not isinstance(node, dict):
                break
        found.append(node)
    out[known] = found
    return out


def _leaf_of(spark: SparkSession, layout: Layout) -> Callable[[Column], Column]:
    """hour -> number of its leaf; every task gets the folded trie, whose size is that of the list of leaves."""
    shared = spark.sparkContext.broadcast(layout.folded)

    @F.pandas_udf("int")
    def descend(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            hours, place = np.unique(b.to_numpy(np.int64), return_inverse=True)
            yield pd.Series(descended(shared.value, hours)[place])

    return descend


def arranged(df: DataFrame, layout: Layout, moment: Column, order: list[str], mark: Column) -> tuple[DataFrame, Callable[[], None]]:
    """(row, number int, part long from 1, copies long, marked, at, o0.., h0, h1) of df's rows, and what deletes the table behind it.

    row has df's columns and lies copies times in that part of leaf number, by at (the moment), the
    order columns and two hashes of the whole row, nulls first; so only equal rows tie. marked is
    mark, which must follow from the row. Columns must be of types that can be grouped. df must have
    just the rows that layout was folded for.
    """
    use_checkpoints(df.sparkSession)
    whole = [*(df[f"`{c}`"] for c in df.columns), *(df[f"`{c}`"].isNull() for c in df.columns)]
    places = [f"o{i}" for i in range(len(order))]
    rows = df.select(
        F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("row"),
        mark.alias("marked"),
        moment.alias("at"),
        hour_of(moment).alias("hour"),
        *(df[f"`{c}`"].alias(o) for c, o in zip(order, places, strict=True)),
        F.xxhash64(*whole).alias("h0"),
        F.xxhash64(F.lit(1), *whole).alias("h1"),
    )
    leaf_of = _leaf_of(df.sparkSession, layout)
    keys = ["number", "at", *places, "h0", "h1"]
    large = {i for i, n in enumerate(layout.rows) if n > layout.limit}
    hours = _hours(layout, large)
    small = rows.where(~F.col("hour").isin(hours)) if hours else rows
    small = small.select("row", leaf_of(F.col("hour")).alias("number"), F.lit(1).cast("long").alias("part"), F.lit(1).cast("long").alias("copies"), "marked", *keys[1:])
    if not hours:
        return small, lambda: None
    each = rows.where(F.col("hour").isin(hours)).groupBy("row", "marked", "hour", *keys[1:]).agg(F.count("*").alias("copies"))
    ranged = each.withColumn("number", leaf_of(F.col("hour"))).drop("hour").repartitionByRange(*keys).withColumn("stretch", F.spark_partition_id())
    table, delete = written(ranged)
    stretch = Window.partitionBy("number").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.groupBy("number", "stretch").agg(F.sum("copies").alias("n")).select("number", "stretch", F.coalesce(F.sum("n").over(stretch), F.lit(0)).alias("start"))
    inside = Window.partitionBy("number", "stretch").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    ranked = table.join(starts, ["number", "stretch"]).withColumn("first", F.col("start") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    last = F.col("first") + F.col("copies") - 1
    cut = F.lit(layout.limit).cast("long")
    of_part = ranked.withColumn("last", last).withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / cut), F.floor(F.col("last") / cut))))
    copies = F.least(F.col("last") + 1, (F.col("part") + 1) * cut) - F.greatest(F.col("first"), F.col("part") * cut)
    return small.unionByName(of_part.select("row", "number", (F.col("part") + 1).alias("part"), copies.alias("copies"), "marked", *keys[1:])), delete


def _hours(layout: Layout, leaves: set[int]) -> list[int]:
    """The hours of leaves that are one hour, and NEVER for that without a moment."""
    out = []

    def walk(node: dict, path: tuple[int, ...]) -> None:
        for k, x in node.items():
            if isinstance(x, dict):
                walk(x, (*path, k))
            elif x in leaves:
                out.append(NEVER if k is None else int(np.datetime64(f"{path[0]:04d}-{path[1]:02d}-{path[2]:02d}", "h").astype(int)) + k)

    walk(layout.folded, ())
    return out


def _in_files(rows: DataFrame, layout: Layout) -> DataFrame:
    """rows with leaf, the leaf's name as a folder has it, all of a file in one task, by file and place in it."""
    places = [c for c in rows.columns if c not in ("row", "number", "part", "copies", "at", "h0", "h1", "marked")]
    dealt = rows.repartition("number", "part").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    names = F.lit([folder_name(x) for x in layout.names])
    named = dealt.withColumn("leaf", F.coalesce(F.get(names, F.col("number")), F.lit("")))
    return named.sortWithinPartitions("leaf", "part", "at", *places, "h0", "h1")


def folder_name(leaf: str) -> str:
    return leaf.replace("/", ".")


def digests(rows: DataFrame, layout: Layout, ids: str) -> DataFrame:
    """(leaf, part, n_rows, n_marked long, ids_sha256, content string) of each file: leaf as a folder has it,
    SHA-256 of a place column's values in file order with commas between (null as nothing), and of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, new, of_ids, of_rows = None, 0, 0, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"leaf": now[0], "part": now[1], "n_rows": n, "n_marked": new, "ids_sha256": of_ids.hexdigest(), "content": of_rows.hexdigest()}], schema=kinds)

        for b in batches:
            if not b.num_rows:
                continue
            number, part = b.column("number").to_numpy(), b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero((number[1:] != number[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), b.num_rows]
            hashes = np.stack([b.column(c).to_numpy() for c in ("h0", "h1")], 1)
            listed, marks = b.column("id").to_pylist(), b.column("marked").to_numpy(zero_copy_only=False)
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                file = b.column("leaf")[x].as_py(), int(part[x])
                if file != now:
                    if now is not None:
                        yield out()
                    now, n, new, of_ids, of_rows = file, 0, 0, hashlib.sha256(), hashlib.sha256()
                of_ids.update((("," if n else "") + ",".join("" if i is None else str(i) for i in listed[x:y])).encode())
                of_rows.update(hashes[x:y].tobytes())
                n, new = n + y - x, new + int(marks[x:y].sum())
        if now is not None:
            yield out()

    kinds = pa.schema([("leaf", pa.string()), ("part", pa.int64()), ("n_rows", pa.int64()), ("n_marked", pa.int64()), ("ids_sha256", pa.string()), ("content", pa.string())])
    sorted_rows = _in_files(rows.drop("row"), layout).select("leaf", "number", "part", "h0", "h1", "marked", F.col(ids).alias("id"))
    return sorted_rows.mapInArrow(run, "leaf string, part long, n_rows long, n_marked long, ids_sha256 string, content string")


def _stored(columns: list[str]) -> list[str]:
    return [c if c not in ("leaf", "part") else f"_{c}" for c in columns]


def write(rows: DataFrame, layout: Layout, folder: str, but: set[tuple[str, int]]) -> None:
    """Arranged rows as folder/leaf=../part=../ with one Parquet file each, but for some; only what is written is replaced."""
    inner = rows.schema["row"].dataType.names
    if but:
        number = {folder_name(x): i for i, x in enumerate(layout.names)}
        kept = rows.sparkSession.createDataFrame([(number[leaf], part) for leaf, part in sorted(but)], "number int, part long")
        rows = rows.join(F.broadcast(kept), ["number", "part"], "left_anti")  # files at most
    files = _in_files(rows, layout).select("leaf", "part", *(F.col("row").getField(c).alias(x) for c, x in zip(inner, _stored(inner), strict=True)))
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("leaf", "part").parquet(folder)


def paths(spark: SparkSession, folder: str) -> dict[tuple[str, int], str]:
    """The data file of each leaf and part, by the folder as it was given."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, out = fs.listFiles(top, True), {}
    while found.hasNext():
        name = found.next().getPath()
        if name.getName().endswith(".parquet"):
            leaf, part = name.getParent().getParent().getName(), name.getParent().getName()
            out[leaf.removeprefix("leaf="), int(part.removeprefix("part="))] = f"{folder}/{leaf}/{part}/{name.getName()}"
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def grow_layout(df: DataFrame, early: Column, moment: Column, order: list[str], folder: str, files: int = 650) -> DataFrame:
    """Write the early rows of df into folder, then rewrite it for all rows; (leaf, columns, ids_sha256, path
    string, part, n_rows, n_new long, rewritten boolean) of each file at the end, where order[-1] is the id.

    A file has at most 1 + rows // files rows of the whole table. Files whose leaf, part and rows recur are not
    touched; the others go. Columns named leaf or part are written with an underscore before. Rows without
    a moment are a leaf of their own, null order columns come first, and a null mark is not early. Equal
    rows each lie in a file; long texts are rows like others, and an empty table leaves no files and no rows.

    The number of files and leaves follows from files and the years alone, so lists of them are held by the driver.
    """
    spark = df.sparkSession
    early = F.coalesce(early, F.lit(False))
    trie = count(df, moment, [early, F.lit(True)])
    limit = 1 + total(trie, 1) // files
    ids = f"o{len(order) - 1}"
    found: list[dict] = []
    for mark, part_of in enumerate((df.where(early), df)):
        layout = fold(trie, mark, limit)
        rows, delete = arranged(part_of, layout, moment, order, ~early)
        is_now = {(r.leaf, r.part): r for r in digests(rows, layout, ids).collect()}
        was = found[-1] if found else {}
        stay = {k for k, r in is_now.items() if k in was and (was[k].n_rows, was[k].content) == (r.n_rows, r.content)}
        if len(stay) < len(is_now):
            write(rows, layout, folder, stay)
        for gone in was.keys() - is_now.keys():
            _delete(spark, f"{folder}/leaf={gone[0]}/part={gone[1]}")
        for leaf in {k[0] for k in was} - {k[0] for k in is_now}:
            _delete(spark, f"{folder}/leaf={leaf}")
        delete()
        found.append(is_now)
    at = paths(spark, folder) if found[1] else {}
    columns = ",".join(_stored(df.columns))
    out = [(r.leaf.replace(".", "/"), columns, r.ids_sha256, at[k], r.part, r.n_rows, r.n_marked, k not in stay) for k, r in sorted(found[1].items())]
    return spark.createDataFrame(out, "leaf string, columns string, ids_sha256 string, path string, part long, n_rows long, n_new long, rewritten boolean")
