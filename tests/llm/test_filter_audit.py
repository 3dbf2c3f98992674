"""The filter audit against filters that are applied one after the other."""

import re
from itertools import permutations

from lodestone.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(200))
TEXTS = [None, "", LONG, LONG, "x " * 200, LONG.upper(), f"{LONG} #", "é A", "A\x1fB\x0bc", f"{LONG} #", "x " * 200, "word " * 50_000, LONG.title()]
SCHEMA = "doc_id long, text string, source string, key int, n int, mask int, part int"


def failed(t, repeated):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), repeated]
    return {c for c, bad in zip("ABCDE", tests, strict=True) if bad}


def brute(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = [(s or "", failed(t, i is not None and i > first[t or ""]), any(k is not None and k == i and q == 1 for k, q, _ in labels), any(k is not None and k == i and x == 1 for k, _, x in labels)) for i, t, s, *_ in rows]
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                goes = [d for d in left if f in d[1]]
                fail = sum(f in d[1] for d in docs if d[0] == part)
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = (len(left), len(goes), fail - len(goes), sum(d[0] == part and d[1] == {f} for d in docs), sum(d[2] for d in goes), sum(d[3] for d in goes))
                shapley[part, f] = shapley.get((part, f), 0) + len(goes)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def same(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.orders(filter_audit.cells(docs, known)).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got) and found == brute(rows, labels)


def test_every_order_over_edge_rows(spark):
    """Nulls, repeated rows and keys, texts equal across parts, long texts, clashing columns, repeated labels."""
    rows = [(i, t, ["a", "b", None][i % 3]) for i, t in enumerate(TEXTS)]
    rows += [(None, LONG, "a"), (None, "", None), (3, LONG, "a"), (3, LONG, "a"), (2, LONG, "b"), (40, "A", "a")]
    same(spark, rows, [(2, 1, 0), (3, 0, 1), (3, 1, None), (3, 1, 1), (4, None, 1), (None, 1, 1), (99, 1, 1)])


def test_a_hot_text_and_part(spark):
    same(spark, [(i, LONG if i % 3 else f"{i}", "a" if i % 2 else "b") for i in range(300)], [(i, 1, i % 2) for i in range(0, 300, 7)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.orders(filter_audit.cells(docs, labels)).count() == 0
    same(spark, [(1, "A", None)], [])
