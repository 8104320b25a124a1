import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampertide.llm import filter_audit as A

LABELS = "doc_id long, quality int, toxic int"


def failing(rows):
    """Per row, the letters of the filters that it fails."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = set()
        if len(words) < 50:
            s.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            s.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            s.add("C")
        if re.search(r"[#$%&*|]", t):
            s.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            s.add("E")
        out.append(s)
    return out


def brute(rows, labels):
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    fails = failing(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r, f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            alive = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in mine[k][1]]
                alive = [k for k in alive if f not in mine[k][1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), sum(f in x for _, x in mine) - len(gone), sum(x == {f} for _, x in mine),
                    sum(mine[k][0][0] in good for k in gone), sum(mine[k][0][0] in toxic for k in gone), f,
                ]
        for (p, o, s), v in out.items():
            if p == part:
                v[6] = shapley[o[s - 1]]
    return out


def audit(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumns({c: F.lit("x") for c in ["id", "part", "mask", "digest", "n", "good", "quality", "cells"]})
    marks = spark.createDataFrame(labels, LABELS).withColumns({c: F.lit("y") for c in ["id", "part", "text", "good"]})
    got = A.filter_audit(docs, marks).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(found) == len(got)
    return found


def some_rows():
    rng = random.Random(3)
    kinds = [
        None, "", " \t\n", "short", "Short # one", "WORD " * 60, "é" * 10 + " A", "word " * 50, "a b " * 60,
        " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), " ".join(f"W{i}|" for i in range(80)),
        "\x0b".join(f"w{i % 40}" for i in range(60)), "x" * 200_000, "$" + " ".join(map(str, range(70))),
    ]
    rows = [(i, rng.choice(kinds), rng.choice([None, "", "s1", "s2"])) for i in range(120)]
    rows += [(7, kinds[9], "s1"), (7, kinds[9], "s2"), (None, kinds[9], "s1"), (None, kinds[9], "s1"), (-4, kinds[5], None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    return rows, labels


def test_audit_equals_brute_force(spark):
    rows, labels = some_rows()
    assert audit(spark, rows, labels) == brute(rows, labels)


def test_walk_states_equal_counts_of_every_subset():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 9, (4, 32, 3))
    states = A.gray_states(cells)
    for on in range(32):
        passing = [m for m in range(32) if not m & on]
        assert (states[:, on] == cells[:, passing].sum(1)).all()


def test_hot_text_and_many_parts(spark):
    rows = [(i, "same " * 70, f"p{i % 90}") for i in range(600)]
    found = audit(spark, rows, [(3, 1, 1)])
    assert len(found) == 90 * 600
    assert sum(v[1] for (p, o, s), v in found.items() if o == "EABCD" and s == 1) == 599
    assert found["p0", "EABCD", 2] == [0, 0, 7, 0, 0, 0, 0] or found["p0", "EABCD", 2][:2] == [1, 0]


@pytest.mark.parametrize("labels", [[], [(1, None, None)]])
def test_no_documents_and_no_labels(spark, labels):
    assert audit(spark, [], labels) == {}
    rows = [(1, None, None)]
    assert audit(spark, rows, labels) == brute(rows, labels)
