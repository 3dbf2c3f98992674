"""Line dedup against a plain Python template tree."""

import re
from collections import Counter, defaultdict

import pytest

from lodestone.llm import line_dedup
from lodestone.llm.common import documents


def split(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line)


def masked(line):
    return tuple(line_dedup.VARIABLE if re.search("[0-9]", x) else x for x in split(line))


def generalised(lines):
    """Tokens of a line -> its template without the leaf's variable fields."""
    leaves, out = defaultdict(set), {}
    for w in map(masked, lines):
        if len(w) >= 7:
            leaves[len(w), w[:3]].add(w)
    for leaf, ws in leaves.items():
        at = Counter((p, w[p]) for w in ws for p in range(3, len(w)))
        for w in ws:
            kept = tuple(w[p] if at[p, w[p]] >= 5 and 4 * at[p, w[p]] >= len(ws) else None for p in range(3, len(w)))
            if len(ws) >= 5 and 0 < kept.count(None) <= len(w) / 3:
                out[w] = ("fields", leaf, kept)
    return out


def brute(rows, least=5):
    """{(key, text): numbers of dropped lines}."""
    order = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    fields = generalised([x for _, text in order for x in text.split("\n")])
    seen, total = defaultdict(list), {}
    for key, text in order:
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if split(x)]
        total[text] = sum(len(split(x)) for _, x in lines)
        for k, (i, x) in enumerate(lines):
            around = (lines[k - 1][1] if k else None, lines[k + 1][1] if k + 1 < len(lines) else None)
            for t in {masked(x), fields.get(masked(x))} - {None}:
                seen[t].append(((key, text), i, around, len(split(x))))
    often = {t: places for t, places in seen.items() if len({doc[1] for doc, *_ in places}) >= least}
    inside = defaultdict(dict)
    for places in often.values():
        for doc, i, _, n in places:
            inside[doc[1]][i] = n
    own = {text for text, at in inside.items() if 2 * sum(at.values()) <= total[text]}
    gone = defaultdict(set)
    for places in often.values():
        around = defaultdict(set)
        for doc, _, a, _ in places:
            around[doc[1]].add(a)
        if len(around.keys() & own) < least:
            every = len(set().union(*around.values()))
            if every < least:
                continue
            chosen = {min(a, key=str) for a in around.values()}
            assert len(chosen) >= least or every < 2 * least, "a case in which the choice of context matters"
            if len(chosen) < least:
                continue
        for doc, i, *_ in places:
            if doc != places[0][0]:
                gone[doc].add(i)
    return gone


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    gone = brute(rows)
    got = sorted(((r.doc_id, r.text, r._dropped) for r in line_dedup.drop_recurring(df).collect()), key=str)
    want = [(k, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k, t]), sorted(gone[k, t])) for k, t in rows]
    assert got == sorted(want, key=str)
    return gone


def test_documents(spark):
    assert check(documents(spark, "/root/testdata/sf0.01"))


def test_variable_fields_and_surroundings(spark):
    rows = [(i, f"intro {chr(97 + i) * 3} text\nPosted by user{i} on 2024-0{i}-11 at noon\nbody {chr(97 + i)} of it") for i in range(1, 8)]
    rows += [(20 + i, f"start {chr(97 + i)} x\nRead more about our {w} here on this site\n\n \nend {chr(110 + i)}") for i, w in enumerate(["cats", "dogs", "mice", "cows", "hens", "bats"])]
    copies = [(40 + i, "same head line\nsame middle line of a copied text\nsame last line") for i in range(9)]
    rows += [*copies, (None, None), (90, ""), (91, "\n\n"), (1, rows[0][1]), (None, "x\nPosted by user9 on 2024-09-11 at noon")]
    df = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, text string, line string")
    gone = check(df)
    assert not any(gone[c] for c in copies)
    assert gone[3, rows[2][1]] == {1} and gone[None, rows[-1][1]] == {1} and not gone[1, rows[0][1]]
    assert line_dedup.drop_recurring(df).columns == ["doc_id", "text", "line", "_dropped"]


def test_fields_without_digits_anywhere_in_the_line(spark):
    names = ["alice", "bob", "carol", "dave", "erin", "frank", "grace", "heidi", "ivan"]
    rows = [(i, f"own line {n * 2} of it\nPosted in the {n[::-1]} section by {n} on our site\nand {n * 3} ends") for i, n in enumerate(names)]
    prose = [(30 + i, f"first {n} here\nIt was the {n} of {n[1:]} {n * 2} that {n[:2]}x\nlast {n} there") for i, n in enumerate(names)]
    gone = check(spark.createDataFrame(rows + prose, "doc_id long, text string"))
    assert [gone[r] for r in rows] == [set()] + [{1}] * 8
    assert not any(gone[r] for r in prose)


def test_blocks_of_lines_go_but_copies_stay(spark):
    block = "Released to all under the licence\nwith no warranty of any kind\nsee the file for more"
    own = [f"{chr(97 + i) * 4} {chr(98 + i) * 5} is what this text is about and {chr(99 + i)} is not\nmore about {chr(97 + i) * 4} comes in this second line of it {chr(98 + i)}" for i in range(7)]
    rows = [(i, f"{block}\n{t}") for i, t in enumerate(own)] + [(10 + i, f"{t} end\n{block}") for i, t in enumerate(own)]
    body = "\n".join(f"line {w} of a text that is copied with an edit" for w in ("one", "two", "three", "four", "five"))
    copies = [(50 + i, f"{body}\nedit {chr(97 + i)}") for i in range(9)]
    gone = check(spark.createDataFrame(rows + copies, "doc_id long, text string"))
    assert all(gone[r] == ({0, 1, 2} if r[1].startswith("Rel") else {2, 3, 4}) for r in rows[1:])
    assert not any(gone[c] - {4} for c in copies)


def test_long_document_and_empty_table(spark):
    df = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(30000))), (2, "w " * 200000)], "doc_id long, text string")
    assert {r.text for r in line_dedup.drop_recurring(df).collect()} == {r.text for r in df.collect()}
    assert line_dedup.drop_recurring(df.where("doc_id = 3")).collect() == []


@pytest.mark.parametrize("names", ["key text hash at context size total", "row line w leaf whole template bucket", "_dropped dropped of_key of_hash m n", "_on token tokens place fixed places", "own doc first around none masked"])
def test_clashing_columns(spark, names):
    rows = [(i, f"a{chr(97 + i)}\nthe line that recurs here\nb{chr(97 + i)}", *map(str, range(len(names.split())))) for i in range(7)]
    extra = [c for c in names.split() if c != "text"]
    df = spark.createDataFrame(rows, ["doc_id", "text", *(c if c != "text" else "Other" for c in names.split())])
    out = line_dedup.drop_recurring(df)
    assert sorted(set(out.columns)) == sorted({*df.columns, "_dropped"})
    got = out.collect()
    assert sum(r.text.count("recurs") for r in got) == 1
    for c in set(extra) - {"_dropped"}:
        assert {r[c] for r in got} == {r[c] for r in df.collect()}
