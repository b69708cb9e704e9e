"""Counts of the filter audit against counting by hand, order by order."""

from __future__ import annotations

import re
from itertools import permutations

import xxhash

from strandloom.llm import filter_audit
from strandloom.llm.filter_audit import FILTERS, audit, failed_filters

LONG = " ".join(f"w{k}" for k in range(250))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, None), (3, LONG, "b"), (1, LONG, "b"), (None, LONG, "a"), (4, None, "a"), (5, "", ""), (6, "", "b"), (7, "UPPER CASE", "b"),
    (8, "a b # c", None), (9, "x " * 300, "a"), (10, "x " * 300 + "|", "a"), (-4, LONG.upper(), "b"), (11, LONG.upper(), "a"), (12, "é" * 90 + "AB", "a"), (None, None, None), (13, "a b " * 200, "b"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (3, None, 1), (7, 1, 1), (11, 1, 0), (None, 1, 1), (99, 1, 1)]
EXTRA = [(100 + k, LONG + f" {k % 9}", "abc"[k % 3]) for k in range(90)]
DOCS, LABEL_COLUMNS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def by_hand(rows, labels):
    texts: dict[str, list] = {}
    for i, t, _ in rows:
        texts.setdefault(t or "", []).append(i)
    ids = lambda t: [i for i in texts[t or ""] if i is not None]
    fails, counts = [], {}
    for i, t, s in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t or "")) > 2 * len(t or ""), "D": bool(re.search(r"[#$%&*|]", t or "")), "E": i is not None and min(ids(t)) < i}
        fails.append((s or "", {k for k, v in bad.items() if v}, any(l == i and q == 1 for l, q, _ in labels if l is not None), any(l == i and x == 1 for l, _, x in labels if l is not None)))
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations(FILTERS):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                redundant = sum(name in f[1] for f in mine) - len(gone)
                left = [f for f in left if name not in f[1]]
                counts[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f[1] == {name} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), c in counts.items():
            if p == part and len(c) == 6:
                c.append(sum(x[1] for (q, o, k), x in counts.items() if q == part and o[k - 1] == order[step - 1]))
    return counts


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in df.collect()}


def tables(spark, rows, labels=LABELS, parts=5):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", mask string").repartition(parts)
    return docs, spark.createDataFrame([(*x, "clash") for x in labels], LABEL_COLUMNS + ", part string")


def test_counts(spark):
    assert found(audit(*tables(spark, ROWS + EXTRA))) == by_hand(ROWS + EXTRA, LABELS)


def test_nothing_held_and_equal_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_BYTES", 0)
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda raw: len(raw) % 3)
    ids = lambda i, low: sorted(filter_audit._copies(iter(sorted(filter_audit._read(iter(low)), key=lambda x: x[0]))), key=str)
    rows = [(i, t, s) for i, t, s in ROWS if i is not None]
    got = ids(0, rows)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(t or "", []).append(i)
    want = sorted(((i, s or "", i > min(texts[t or ""])) for i, t, s in rows), key=str)
    assert sorted(((i, s, bool(m & filter_audit.COPY)) for i, s, m, n in got for _ in range(n)), key=str) == want


def test_a_third_are_copies_of_one_text(spark):
    rows = [(k, LONG if k % 3 == 0 else f"{LONG} {k}", "hot" if k % 2 else "cold") for k in range(600)]
    masks = failed_filters(tables(spark, rows)[0]).collect()
    assert {r["id"] for r in masks if r["mask"] & filter_audit.COPY} == set(range(3, 600, 3))
    assert sum(r["n"] for r in masks) == 600


def test_empty_tables(spark):
    docs, labels = tables(spark, ROWS)
    assert audit(docs.limit(0), labels).collect() == []
    assert found(audit(docs, labels.limit(0))) == by_hand(ROWS, [])
